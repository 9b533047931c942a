"""Co-bucketed tables, against a plain version that reads the files."""

import datetime
import glob
import hashlib
import os
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from agora.llm import cobucket

from ..conftest import SF

DAY = datetime.datetime(2024, 1, 1)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rank(v):
    return (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)


def plain(sales, lines, cols, numbers):
    """{(table, bucket): (rows in order, {start: n}, joined, stays)}"""
    known = {r[0] for r in sales if r[0] is not None}
    out, start = {}, defaultdict(Counter)

    def bucket(i, own):
        return 601 if i is None else 600 if not own and i not in known else zlib.crc32(f"s{i}".encode()) % 600

    made = {}
    for name, rows in (("sales", sales), ("sale_lines", lines)):
        of = defaultdict(list)
        for r in rows:
            b, s = bucket(r[0], name == "sales"), numbers[name](r)
            of[b].append((s, r))
            start[name, s][b] += 1
        made[name] = of
    per = [Counter(r[0] for r in rows) for rows in (sales, lines)]
    for name, of in made.items():
        for b, rows in of.items():
            order = sorted((r for _, r in rows), key=lambda r: [rank(x) for x in r[1:]])
            order.sort(key=lambda r: (r[0] is not None, -(r[0] or 0)))
            flow = Counter(s for s, _ in rows)
            joined = sum(n * per[1][i] for i, n in per[0].items() if i is not None and bucket(i, True) == b) if b < 600 else 0
            stays = len(flow) == 1 and len(start[name, next(iter(flow))]) == 1
            out[name, b] = (order, flow, joined, stays)
    return out


def held(got, want, home):
    assert {(r.table_name, r.bucket) for r in got} == set(want)
    assert len(got) == len(want)
    for r in got:
        order, flow, joined, stays = want[r.table_name, r.bucket]
        t = pq.ParquetFile(urlparse(r.path).path).read()
        assert ",".join(t.column_names) == r.columns
        assert [tuple(x.values()) for x in t.to_pylist()] == order
        assert r.ids_sha256 == sha(",".join("" if x[0] is None else str(x[0]) for x in order))
        assert r.lineage_sha256 == sha(",".join(f"{s}:{n}" for s, n in sorted(flow.items())))
        assert (r.n_rows, r.n_joined, r.rewritten) == (len(order), joined, not stays)
    found = [p for p in glob.glob(f"{home}/**", recursive=True) if os.path.isfile(p)]
    assert sorted(found) == sorted(urlparse(r.path).path for r in got)


def sales_number(r):
    b = 601 if r[0] is None else zlib.crc32(f"s{r[0]}".encode()) % 600
    return b - 1 if b % 4 == 1 else b


def folder(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/of-{os.urandom(6).hex()}"


def rows_of(spark, name):
    return [tuple(x.values()) for x in pq.read_table(f"{SF}/{name}.parquet").to_pylist()]


def test_given_tables(spark):
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/cobucket-*"))
    got = cobucket.op12_cobucket(spark, SF).collect()
    (home,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/cobucket-*")) - before
    cols = {n: pq.read_schema(f"{SF}/{n}.parquet").names for n in ("sales", "sale_lines")}
    item = cols["sale_lines"].index("item_id")
    numbers = {"sales": sales_number, "sale_lines": lambda r: 0 if r[item] is None else zlib.crc32(str(r[item]).encode()) % 600}
    want = plain(rows_of(spark, "sales"), rows_of(spark, "sale_lines"), cols, numbers)
    held(got, want, home)
    assert any(not r.rewritten for r in got) and any(r.rewritten for r in got)


def test_odd_rows(spark):
    """Nulls, repeated rows, one hot key, lines without a sale, clashing names, a line file that is a whole bucket."""
    sales = [(1, "b", 1.0, None), (1, "a", 2.0, "x"), (1, "a", 2.0, "x"), (None, "n", None, "é"), (7, None, 0.5, "z"), (8, "z", 0.5, "\U0001f600")]
    lines = [(1, k % 3, f"v{k % 5}") for k in range(300)] + [(7, 9, "é"), (7, 9, None), (99, 2, "lost"), (None, None, "null"), (None, 4, "null"), (8, 50, "only")]
    a = spark.createDataFrame(sales, "sale_id long, start string, bucket double, known string")
    b = spark.createDataFrame(lines, "sale_id long, item_id long, n string")
    home = folder(spark)
    item = F.coalesce(F.pmod(F.crc32(F.col("item_id").cast("string")), F.lit(600)), F.lit(0))
    s = cobucket.crc_bucket("sale_id")
    got = cobucket.cobucket(cobucket.Table("sales", a, F.when(s % 4 == 1, s - 1).otherwise(s)), cobucket.Table("sale_lines", b, item), "sale_id", home).collect()
    numbers = {"sales": sales_number, "sale_lines": lambda r: 0 if r[1] is None else zlib.crc32(str(r[1]).encode()) % 600}
    want = plain(sales, lines, None, numbers)
    held(got, want, home)
    assert want["sale_lines", zlib.crc32(b"s8") % 600][3]
    again = spark.read.option("recursiveFileLookup", True).parquet(f"{home}/sale_lines")
    assert sorted(map(repr, map(tuple, again.collect()))) == sorted(map(repr, lines))


@pytest.mark.parametrize("empty", ["both", "sales", "sale_lines"])
def test_empty_tables(spark, empty):
    a, b = spark.createDataFrame([(3, "x")], "sale_id long, a string"), spark.createDataFrame([(3, 1), (4, 1)], "sale_id long, item_id long")
    a, b = (x.limit(0) if empty in ("both", n) else x for x, n in ((a, "sales"), (b, "sale_lines")))
    got = cobucket.cobucket(cobucket.Table("sales", a, F.lit(0)), cobucket.Table("sale_lines", b, F.lit(1)), "sale_id", folder(spark)).collect()
    assert {(r.table_name, r.bucket) for r in got} == {"both": set(), "sales": {("sale_lines", 600)}, "sale_lines": {("sales", zlib.crc32(b"s3") % 600)}}[empty]


@pytest.mark.parametrize("parts", [1, 7, 602])
def test_surrogates_are_dealt_one_to_one(spark, parts):
    keys = cobucket.surrogates(spark, parts)
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(parts, "k").select("k", F.spark_partition_id().alias("p"))
    assert {r.k: r.p for r in df.collect()} == {k: p for p, k in enumerate(keys)}
