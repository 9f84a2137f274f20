"""Source divergence audit: how far the words of each source of a language are from those of its other sources, and which words make a source odd.

Documents are counted where they are read (SQL over blocks of texts in DuckDB), counts go to shards by a hash of language and term, each shard adds them up and makes partial
pair sums and rankings by SQL; Spark adds the sums and merges the rankings.

All pairs of sources over all terms would be terms x sources squared. A term that a source lacks has the same rate in it whatever the term, so a sum over all terms is taken apart:

    sum f(p, q) = A + B + C + f(p0, q0) * (V - terms of a - terms of b)

A: a's terms against b's rate of absent terms, from a's histogram of counts; B: the same the other way; C: over terms of both only, what they add to A, B and the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, partitions, quoted, stash, tidy

#: Fixed values of the audit: a term's least number of documents in its language, the rate scale, ranks of terms that are returned.
LEAST_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
#: Bytes of text that are counted at a time, rows that a shard takes in before it adds them up, rows of a block of whole terms.
COUNT_BYTES, MERGE_ROWS, PAIR_ROWS = 16 << 20, 2_000_000, 500_000
#: Groups (language and source) up to which their table is broadcast; beyond, it is joined by a salted key.
BROADCAST_GROUPS, SALTS = 50_000, 16

_COUNT = r"""
with w as (select lang, source, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
o as (select lang, source, term, r, count(*) as n from w group by all)
select lang, source, term, cast(sum(n) as bigint) as n, count(*) as docs from o group by all"""
_MERGE = "select lang, source, term, cast(sum(n) as bigint) as n, cast(sum(docs) as bigint) as docs from c group by all"
_KEPT = f"select lang, term, list(source) as sources, list(n) as counts from ({_MERGE}) group by all having sum(docs) >= {LEAST_DOCS} order by lang, term"
_RATE = f"(1 + ((cast({{}} as hugeint) + 1) * {SCALE}) // {{}})"
_X = f"""
with g as (select *, row_number() over () as g from (select distinct lang, source, total, kept, all_total from rows_))
select tid, g, rows_.lang, rows_.source, term, cast({_RATE.format('n', '(total + kept)')} as bigint) as p, cast({_RATE.format('0', '(total + kept)')} as bigint) as p0,
  cast({_RATE.format('sum(n) over (partition by tid)', '(all_total + kept)')} as bigint) as q
from rows_ join g using (lang, source, total, kept, all_total)"""
_F = "(({0} - {1}) * ({0} - {1}) // {1})"
_PAIRS = f"""
with s as (select a.g as x, b.g as y, sum({_F.format('a.p', 'b.p')} - {_F.format('a.p', 'b.p0')} - {_F.format('a.p0', 'b.p')} + {_F.format('a.p0', 'b.p0')}) as v from x a join x b on a.tid = b.tid and a.g <> b.g group by 1, 2),
g as (select distinct g, lang, source from x)
select 'pair' as part, ga.lang, ga.source, gb.source as item, cast(v as decimal(38, 0)) as value from s join g ga on ga.g = x join g gb on gb.g = y"""
_TERMS = f"""
select 'term' as part, lang, source, term as item, cast({_F.format('p', 'q')} as decimal(38, 0)) as value from x where p > q qualify row_number() over (partition by g order by {_F.format('p', 'q')} desc, term) <= {TOP_TERMS}"""
_COUNTS = "lang string, source string, term string, n long, docs long"
_SUMS = "part string, lang string, source string, item string, value decimal(38,0)"


def _db() -> duckdb.DuckDBPyConnection:
    """A database in memory, of one thread, that never writes to the machine's disk."""
    con = duckdb.connect()
    con.execute("set threads = 1; set temp_directory = ''; set preserve_insertion_order = false")
    return con


def _batches(con: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_table().to_batches(50_000)


def _packed(batches: Iterator[pa.RecordBatch], name: str, size: int) -> Iterator[pa.Table]:
    """Tables of about `size` bytes of text, from batches of any size."""
    held, had = [], 0
    for batch in batches:
        for part in blocks(batch, name, size):
            held.append(part)
            had += part.nbytes
            if had >= size:
                yield pa.Table.from_batches(held)
                held, had = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _db()
    for table in _packed(batches, "text", COUNT_BYTES):
        con.register("d", table.append_column("r", pa.array(range(len(table)), pa.int64())))
        yield from _batches(con, _COUNT)
        con.unregister("d")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard: adds up the counts of its terms and keeps those of enough documents, one row each with its sources."""
    con, rows = _db(), 0
    con.execute("create table c (lang varchar, source varchar, term varchar, n bigint, docs bigint)")
    for batch in batches:
        con.register("b", pa.Table.from_batches([batch]))
        con.execute("insert into c select * from b")
        con.unregister("b")
        rows += batch.num_rows
        if rows >= MERGE_ROWS:
            con.execute(f"create table m as {_MERGE}; drop table c; alter table m rename to c")
            rows = 0
    yield from _batches(con, _KEPT)


def _whole_terms(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that hold all rows of their terms (tid), which lie together."""
    held, had = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        had += batch.num_rows
        if had < rows:
            continue
        table = pa.Table.from_batches(held)
        tid = table.column("tid").combine_chunks().to_numpy()
        last = int((tid != tid[-1]).sum())  # rows of the last term come last
        if last:
            yield table.slice(0, last)
            held, had = table.slice(last).to_batches(), len(tid) - last
    if held:
        yield pa.Table.from_batches(held)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _db()
    for table in _whole_terms(batches, PAIR_ROWS):
        con.register("rows_", table)
        con.execute(f"create or replace temp table x as {_X}")
        yield from _batches(con, _PAIRS)
        yield from _batches(con, _TERMS)
        con.unregister("rows_")


def _rate(count: str, total: str, kept: str = "kept") -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact for any count; null without kept terms."""
    return F.expr(f"1 + (cast({count} as decimal(20,0)) + 1) * {SCALE} div nullif(cast({total} as decimal(20,0)) + cast({kept} as decimal(20,0)), 0)")


def _f(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}").cast("decimal(38,0)")


def _meet(rows: DataFrame, groups: DataFrame, on: list[str], small: bool) -> DataFrame:
    """`rows` with the group table: broadcast up to BROADCAST_GROUPS groups, else by a salted key, so that a language with most rows is split."""
    if small:
        return rows.join(F.broadcast(groups), on)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every occurring language and source.

    Null text, language and source count as ''. Every row is a document, repeated ids too; extra columns are ignored. A source without terms has the rates of absent terms; in
    a language without kept terms every pair has 0. The only source of a language has no pairs. Equal values are ranked by the item's bytes. No documents: no rows.
    """
    spark = docs.sparkSession
    own = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    texts = docs.select(own(lang_col).alias("lang"), own(source_col).alias("source"), own(text_col).alias("text"))
    counted = texts.mapInArrow(tidy(_count), _COUNTS).repartition(partitions(spark), "lang", "term")
    kept = stash(counted.mapInArrow(tidy(_kept), "lang string, term string, sources array<string>, counts array<long>"))
    long = kept.withColumn("tid", F.monotonically_increasing_id()).select("tid", "lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("z")).select("tid", "lang", F.col("z.sources").alias("source"), "term", F.col("z.counts").alias("n"))

    sums = long.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "kept"])
    groups = stash(groups.join(groups.groupBy("lang").agg(F.sum("total").alias("all_total")), "lang"))
    small = groups.count() <= broadcast_groups

    whole = _meet(long, groups.drop("terms"), ["lang", "source"], small)
    if not small:
        whole = whole.repartition(partitions(spark), "tid").sortWithinPartitions("tid")
    shards = stash(whole.select("tid", "lang", "source", "term", "n", "total", "kept", "all_total").mapInArrow(tidy(_sums), _SUMS))

    rated = groups.filter("kept > 0").withColumn("p0", _rate("0", "total"))
    other = rated.select("lang", F.col("source").alias("item"), F.col("total").alias("other_total"), F.col("terms").alias("other_terms"), F.col("p0").alias("q0"))
    counts = _meet(long.groupBy("lang", "source", "n").agg(F.count("*").alias("k")), rated, ["lang", "source"], small).withColumn("p", _rate("n", "total"))
    faced = _meet(counts.select("lang", "source", "p", "p0", "k"), other, ["lang"], small).filter("source <> item")
    both = faced.groupBy("lang", "source", "item").agg(F.sum(F.col("k") * _f("p", "q0")).cast("decimal(38,0)").alias("a"), F.sum(F.col("k") * _f("q0", "p")).cast("decimal(38,0)").alias("b"))
    pairs = _meet(groups.select("lang", "source", "kept", "terms", "total"), groups.select("lang", F.col("source").alias("item"), F.col("terms").alias("other_terms"), F.col("total").alias("other_total")), ["lang"], small).filter("source <> item")
    absent = pairs.withColumn("p0", _rate("0", "total")).withColumn("q0", _rate("0", "other_total")).select("lang", "source", "item", F.coalesce((F.col("kept") - F.col("terms") - F.col("other_terms")) * _f("p0", "q0"), F.lit(0)).cast("decimal(38,0)").alias("value"))
    every = absent.unionByName(both.select("lang", "source", "item", F.col("a").alias("value"))).unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("b").alias("value")))
    every = every.unionByName(shards.filter("part = 'pair'").drop("part"))
    pair = every.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair"))

    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    term = shards.filter("part = 'term'").withColumn("value", F.col("value").cast("long")).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP_TERMS)
    return pair.withColumn("rank", F.row_number().over(by)).unionByName(term).select("lang", "source", "part", "item", "value", "rank")


def oracle_sql() -> str:
    rate = lambda n, total, kept: f"cast(1 + (cast({n} as hugeint) + 1) * {SCALE} // ({total} + {kept}) as bigint)"
    return rf"""
with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select lang, source, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from w group by 1, 2 having count(distinct r) >= {LEAST_DOCS}),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by 1, 2, 3),
v as (select lang, count(*) as kept from k group by 1),
g as (select lang, source, coalesce(kept, 0) as kept, coalesce((select sum(n) from c where c.lang = s.lang and c.source = s.source), 0) as total from (select distinct lang, source from d) s left join v using (lang)),
x as (select g.lang, g.source, k.term, coalesce(n, 0) as n, kept, total, sum(coalesce(n, 0)) over (partition by g.lang, k.term) as all_n, t.all_total from g join k using (lang) left join c using (lang, source, term) join (select lang, sum(total) as all_total from g group by 1) t using (lang)),
p as (select lang, source, term, n, {rate("n", "total", "kept")} as p, {rate("all_n", "all_total", "kept")} as q from x),
pv as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pr as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
tr as (select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // q as bigint) as value from p where n > 0 and p > q),
u as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pr union all select * from tr))
select lang, source, part, item, value, cast(rank as integer) as rank from u where part = 'pair' or rank <= {TOP_TERMS}"""
