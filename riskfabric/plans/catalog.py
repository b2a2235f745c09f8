"""Registry of named queries, each with the SQL that checks it on the same tables."""

import re

CHECKS = {}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

# name -> SQL of a bound view, in dependency order (filled by bindings.py)
VIEWS = {}


def expand(sql: str) -> str:
    """Prefix a statement with the bound views it uses, directly or through each other."""
    needed, frontier = set(), [sql]
    while frontier:
        text = frontier.pop()
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                frontier.append(body)
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed)
    sql = sql.strip()
    if not ctes:
        return sql
    head = re.match(r"WITH (RECURSIVE )?", sql, re.I)
    if head:
        return f"WITH {head.group(1) or ''}{ctes},\n{sql[head.end():]}"
    return f"WITH {ctes}\n{sql}"


def check(name: str, sql: str = None):
    """Register a query ``(spark, folder) -> DataFrame`` and its SQL counterpart."""
    def register(function):
        if name in CHECKS:
            raise ValueError(f"duplicate query {name}")
        CHECKS[name] = (function, expand(sql) if sql else None)
        return function
    return register


TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}
#: Session setting: partitions that text tables are dealt to. Unset, a table keeps the splits of its files; a file of one row group cannot be split.
SPREAD = "spark.riskfabric.textPartitions"


def table(spark, folder, name):
    """A driver table; text tables are dealt out by key where the session asks for it."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    parts = spark.conf.get(SPREAD, None)
    return df.repartition(int(parts), TEXT_TABLES[name]) if parts and name in TEXT_TABLES else df


def text_list(values) -> str:
    """A SQL list literal of strings."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def text_rows(mapping: dict) -> str:
    """SQL VALUES rows of a two-column text mapping."""
    q = lambda v: "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in mapping.items()) + ")"


def sql_tokens(expr: str, pattern=r"[a-z]+(?:-[a-z]+)?") -> str:
    return f"regexp_extract_all(lower({expr}), '{pattern}')"


def sql_hits(tokens: str, lexicon) -> str:
    return f"len(list_intersect(list_distinct({tokens}), {text_list(lexicon)}))"


def sql_any(lowered: str, markers) -> str:
    return "(" + " OR ".join(f"contains({lowered}, '" + m.replace("'", "''") + "')" for m in markers) + ")"


def sql_case(expr: str, mapping: dict, default="NULL") -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {expr} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {default} END"
