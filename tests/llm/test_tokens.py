import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskfabric.llm import bpe, pieces, queries, shared, tokencount, tokenfile

FOLDER = "/root/testdata/sf0.001"
RANKS, PATTERN, FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")
CHARACTERS = list(" \n\t\r\x0b\x1c\x85\xa0 　'srelvtdmaABé中ß1²2!?|_<") + ["<|endoftext|>", "    ", "'ll ", "aaaaaaaa"]


def _texts(count, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(CHARACTERS) for _ in range(rnd.randrange(50))) for _ in range(count)]


def test_tree_equals_the_library_at_every_cut():
    encoder, tokens = bpe.load(RANKS, PATTERN)
    for i, text in enumerate(_texts(4000, 2) + ["x" * 5000, "ab" * 3000 + " " + "é" * 3000, " " * 700 + "a"]):
        want = encoder.encode_ordinary(text)
        ids = bpe.encode_tree(text, encoder.encode_ordinary, leaf=1 + i % 9 if len(text) < 100 else 64)
        assert ids.tolist() == want
        assert bpe.decode_tree(ids, tokens, leaf=3) == text.encode()


def test_op2_equals_the_library(spark):
    encoder, _ = bpe.load(RANKS, PATTERN)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op2_byte_bpe(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(encoder.encode_ordinary(docs[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens * 4, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_bpe_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (None, "a b", 7)], "doc_id long, text string, ids int")
    rows = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert [(r.doc_id, len(r.ids), bytes(r.decoded)) for r in rows] == [(1, 0, b""), (2, 0, b""), (2, 0, b""), (None, 8, b"a b")]
    assert bpe.encode(docs.limit(0), RANKS, PATTERN).count() == 0


def test_pieces_equal_the_library_in_blocks_and_after_forgetting():
    library = Tokenizer.from_file(FILE)
    texts = [*_texts(6000, 3), None, "don't", "it's-a", "x'll y'RE", " 're", "''s", "a'tb'", "\n's", "a1b", "a²", "ÀÖ÷ø", "aÀ", "word\u0301 next", "a,b c", "hello <|endoftext|> world",
             " <|endoftext|>  ", "<|endoftext|><|endoftext|>", "<|endof" * 9, "x" * 3000, "word " * 900]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for remembered, block in ((1 << 16, 1 << 20), (50, 700)):
        coder, got = pieces.Coder(FILE, remembered), [[] for _ in texts]
        for rows, data, offsets in pieces.blocks(pa.array(texts), block):
            ids, bounds = coder.encode(data, offsets)
            for row, low, high in zip(rows, bounds[:-1], bounds[1:]):
                got[row] += ids[low:high].tolist()
        assert got == want


def test_files_of_another_kind_are_refused():
    with pytest.raises(ValueError):
        pieces.Coder(public_tokenizers.path("word_bpe_49k.json"))


def test_op6_equals_the_library(spark):
    library = Tokenizer.from_file(FILE)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got, start = {r.doc_id: r for r in queries.op6_token_files(spark, FOLDER).collect()}, 0
    assert len(got) == len(docs)
    for key in sorted(docs):
        ids = [*library.encode(docs[key], add_special_tokens=False).ids, 2]
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_of_special_strings_long_texts_and_clashing_names(spark):
    library, texts = Tokenizer.from_file(FILE), ["hello <|endoftext|> world", "ab cd, " * 400_000, "z" * 20_000, "", None]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, key long, number string")
    rows = {r.key: r for r in tokenfile.read_documents(tokenfile.write(docs, shared.shared_folder(spark, "tokens"), FILE)).collect()}
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (rows[i].n_tokens, rows[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_op13_equals_the_library(spark):
    library = Tokenizer.from_file(FILE)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op13_token_counts(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


@pytest.mark.parametrize("entries", [0, 7, 1 << 16])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_do_not_depend_on_the_table(spark, name, entries):
    path = public_tokenizers.path(name)
    texts = [None, "", "a", "a", "hello <|endoftext|> world", "word " * 5000, "x" * 5000, " \n  b\u3000c's", *_texts(300, 9)]
    docs = spark.createDataFrame([(None if i == 2 else i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, extra string")
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rows = tokencount.count(docs, path, limit=100, entries=entries)
    assert rows.columns == ["doc_id", "text", "extra", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((t or "", len((t or "").encode()), n := count(t or ""), n > 100) for t in texts)
    assert sorted((r.text or "", r.n_bytes, r.n_tokens, r.over_limit) for r in rows.collect()) == want
    assert tokencount.count(docs.limit(0), path).count() == 0


def test_files_hold_equal_sequences_and_masks(spark):
    docs = spark.createDataFrame([(3, "c d e f g"), (1, None), (None, "x"), (2, "a " * 40), (2, "a " * 40)], "doc_id long, text string")
    files = tokenfile.write(docs, shared.shared_folder(spark, "tokens"), FILE, length=8)
    total = 0
    for f in files.collect():
        seen = 0
        for batch in tokenfile.sequences(f.file):
            assert pa.types.is_fixed_size_list(batch.schema.field("input_ids").type) and batch.schema.field("input_ids").type.list_size == 8
            mask = batch.column(1).flatten().to_pylist()
            assert mask == sorted(mask, reverse=True)
            seen += sum(mask)
        assert seen == f.ids
        total += seen
    rows = sorted(tokenfile.read_documents(files).collect(), key=lambda r: r.start)
    assert [r.key for r in rows] == [None, 1, 2, 2, 3] and sum(r.n_tokens for r in rows) == total
    empty = tokenfile.write(docs.limit(0), shared.shared_folder(spark, "tokens"), FILE)
    assert empty.count() == 0 and tokenfile.read_documents(empty).count() == 0
