import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import SCHEMA, documents, with_extras
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import token_files as tf
from pairloom.runtime import scratch_path, stage

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return tf.Encoder.read(PATH, end_id=1)


def library_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


ODD = [
    "It's HER dog's <|endoftext|>tail<|startoftext|>. <|endoftext|>", "<|endoftext", "a<|endoftext|>...", "don't, I'LL'd 's'",
    "x́. é, É! H̱ ẖ", "ẞ İstanbul ΣΣΣ ﬁne Å ǅ", "a b c\u0085d　e\x1cf\x1dg\x00h\x7f",
    "12,345.67 v2.0 3rd (foo)[bar]{baz} --- *** @user #tag", "Wörter; ÉCOLE? naïve... 日本語。 한국어 हिन्दी ไทย", "😀👍🏽 ë́ ≮ ≠",
    "A" * 5000 + "!" * 3000, "\t\x0b\x0c\r\n", "ab‍cd ﻿x ­", "ABC.DEF,ghi", "각 각",
]


def random_text(rng):
    letters = "abcXYZé̱́'’.,!<|>09  \n\x1f_-ßΣ日"
    return "".join(rng.choices(letters, k=rng.randint(0, 60)))


def test_word_ids_equal_library(encoder):
    rng = random.Random(3)
    texts = ODD + [random_text(rng) for _ in range(3000)]
    words = tf.WordIds(Tokenizer.from_file(PATH), encoder.width)
    got = [np.frombuffer(b"".join(map(words.__getitem__, t.encode().split())), encoder.width).tolist() for t in texts]
    assert encoder.by_words
    assert got == [x[:-1] for x in library_ids(texts)]


def test_cache_is_bounded(monkeypatch, encoder):
    monkeypatch.setattr(tf, "CACHED_WORDS", 4)
    words = tf.WordIds(Tokenizer.from_file(PATH), encoder.width)
    for i in range(50):
        words[b"w" * (i + 1)]
        assert len(words) <= 5 and all(len(w) <= tf.CACHED_BYTES for w in words)


def test_other_settings_encode_whole_texts():
    other = tf.Encoder.read(public_tokenizers.path("byte_bpe_50k.json"), end_id=50256)
    assert not other.by_words
    with pytest.raises(ValueError):
        tf.Encoder.read(PATH, end_id=10**6)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> (8 * rng.integers(0, 4, n, dtype=np.uint64))).astype(np.uint32)
    control, data = tf.pack(values)
    assert len(control) == -(-n // 4)
    assert len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in values)
    assert tf.unpack(control, data, n).tolist() == values.tolist()


def expected(rows):
    ids = library_ids([t for _, t in rows])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, zlib.crc32(np.array(ids[i], "<u2").tobytes())))
    out, at = [], 0
    for i in order:
        out.append((rows[i][0], at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        at += len(ids[i])
    return sorted(out, key=repr)


def test_files_hold_the_library_ids(spark, encoder, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_IDS", 500)
    rows = [(i, t) for i, t, _ in documents()] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    rows += [(None, "no id"), (None, None), (7, "another text of one id"), (7, "a third"), (-5, "below"), (-5, "below")]
    docs = with_extras(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(7)
    folder = scratch_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tf.save_tokens(docs.withColumns({"key": F.lit("x"), "ids": F.lit(1)}), encoder, folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = tf.read_tokens(spark, folder).withColumn("crc", F.crc32("ids")).drop("ids").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)

    # A file of an attempt that was not committed is not read; a torn file is noticed.
    store, root = tf.storage(folder)
    with store.open_output_stream(f"{root}/shard-000000-lost.tok") as out:
        out.write(b"half a fi")
    assert tf.read_tokens(spark, folder).count() == len(rows)
    manifest = spark.read.parquet(f"{folder}/manifest")
    assert manifest.count() > 1 and manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    name = manifest.first()["name"]
    with store.open_output_stream(f"{root}/{name}") as out:
        out.write(tf.MAGIC)
    with pytest.raises(Exception, match="the manifest has"):
        tf.read_tokens(spark, folder).collect()


def test_empty_table(spark, encoder):
    folder = scratch_path(spark, "tokens")
    tf.save_tokens(spark.createDataFrame([], SCHEMA), encoder, folder)
    assert tf.read_tokens(spark, folder).collect() == []


def test_ranks_are_by_frequency(spark, encoder):
    docs = spark.createDataFrame([(1, "b b b a a c"), (2, "b c d")], "doc_id bigint, text string")
    ids = stage(tf.token_ids(docs, encoder), "ids")
    ranks = tf.frequency_ranks(ids, encoder).tolist()
    a, b, c, d = (library_ids([x])[0][0] for x in "abcd")
    assert ranks[0] == b and ranks[1:4] == sorted([1, a, c]) and ranks[4] == d
    assert sorted(ranks) == list(range(encoder.n_ids))
    assert ranks[5:] == sorted(ranks[5:])


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = tf.op13_token_files(spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)


def test_ascii_words_equal_library_and_take_no_pattern(encoder):
    ids = tf.WordIds(Tokenizer.from_str(encoder.settings), encoder.width)
    by_pattern, plain = [], ids.plain
    ids.plain = lambda text: by_pattern.append(text) or plain(text)
    texts = ["hello", "Hello,", "HELLO", "word.)!", "a" * 60, "B" * 60 + "_~"]
    got = [np.frombuffer(ids[t.encode()], encoder.width).tolist() for t in texts]
    assert got == [i[:-1] for i in library_ids(texts)]
    assert set(by_pattern) == {",", ".)!", "_~"}
