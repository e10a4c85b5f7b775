"""Token files by stripe and row group, and the encoder against the library in odd places."""

import glob
import itertools

import numpy as np
from pyarrow import orc

from recordweave.llm import bpe, token_orc
from recordweave.llm.common import shared_dir


def scanned(df):
    """Rows that a scan handed on, after stripes and row groups were skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_stripes_are_skipped_by_statistics_and_bloom_filters(spark):
    n, path = 40_000, shared_dir(spark, "t")
    docs = spark.range(n).selectExpr("id * 2 as doc_id", "concat_ws(' ', transform(sequence(1, 12), i -> hex(xxhash64(id, i)))) as text")
    token_orc.write(docs, path, end_id=2, partitions=1, stripe_bytes=1 << 20, row_stride=1000)
    (file,) = glob.glob(path.removeprefix("file:").replace("///", "/") + "/*.orc")
    assert orc.ORCFile(file).nstripes > 2
    rows = spark.read.orc(path)
    assert scanned(rows.where("doc_id >= 0")) == n
    one = rows.where("doc_id = 40000")  # statistics: one row group of one stripe at most
    assert one.count() == 1 and 1 <= scanned(rows.where("doc_id = 40000")) <= 1000
    # odd ids are inside every row group's range, but in no document: only a Bloom filter can tell
    missed = [scanned(rows.where(f"doc_id = {i}")) for i in range(20_001, 20_041, 2)]
    assert missed.count(0) >= 17
    got = token_orc.read(spark, path)
    assert got.count() == n and got.where("doc_id = 40000").count() == 1


def test_every_pair_of_kinds_of_characters():
    e = bpe.encoder(bpe.default_path())
    kinds = ["a", "é", "中", "1", "٣", "'", "_", "!", "×", " ", "\n", "\t", "\u00a0", "\u3000", "'s", "'re", "'x", "²", "\x1c", "😀"]
    texts = ["".join(p) for n in (1, 2, 3) for p in itertools.product(kinds, repeat=n)]
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        for t, got in zip(part, e.encode_many(part), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == e.tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_every_known_character_in_its_places():
    e = bpe.encoder(bpe.default_path())
    known = [chr(i) for i in np.flatnonzero(e.classes != bpe._STRANGE).tolist()]
    texts = [f"a{c}b {c} 1{c}{c}\n{c}" for c in known]
    for lo in range(0, len(texts), 2000):
        part = texts[lo : lo + 2000]
        want = [x.ids for x in e.tok.encode_batch_fast(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_many(part)] == want


def test_the_table_starts_over_and_long_words_are_whole():
    small = bpe.Encoder(bpe.default_path(), cache_entries=50, table_bits=18)
    texts = [f"word{i} {'x' * (i % 90)} it's {i}" for i in range(300)] + [None, "", "a<|endoftext|>b"]
    for lo in range(0, len(texts), 25):
        part = texts[lo : lo + 25]
        for t, got in zip(part, small.encode_many(part), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == small.tok.encode(t or "", add_special_tokens=False).ids
    assert small.table.entries < 400
