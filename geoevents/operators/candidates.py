"""Link candidates in factorised form: groups, ranges and positions instead of pairs, with one rule for each pair.

The first rule that holds for two articles counts: alike keywords, then near in place and time, then one topic within a period. Alike keywords hold
between groups of articles with equal keyword sets, and one topic between an article and a stretch of the topic's time order; a pile of copies or a busy topic therefore
costs rows in proportion to its articles, not to their pairs. The tables here say all pairs exactly:

* ``members``: the group of each article, and its positions in the three orders below.
* ``keyword``: of an article and a group alike to its own (or its own), the older members, as a range of the order (group, time).
* ``place``: pairs near each other that are not alike in keywords.
* ``topic``: the older articles of an article's category within the period, as a range of the order (category, time).
* ``topic_less``: what a topic range holds that keywords already paired, as ranges of the order (category, group, time); place pairs of one category are the other part.

The newer article of a pair comes first, of equal times the one with the smaller id. Positions count from 1 over a whole order and are those in ``members``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, saved
from .pairs import DISASTER_DAYS, HOUR, KEYWORD_JACCARD, MET_AT_ONCE, TOPIC_HOURS, alike_in_block, in_blocks, keyword_sets, mention_windows, news_place_pairs
from .skew import running_count

BATCH = 10


ROW, BEFORE, AFTER = 1, 0, 2


def ranges(rows: DataFrame, probes: DataFrame, keys: list[str], position: str) -> tuple[DataFrame, DataFrame]:
    """Where each probe stands in the time order of its key: ((id, position) of the rows, (asker, keys, from_pos, to_pos)).

    rows: id, keys, t_us. probes: asker, keys, t_us, since_us: asks for the rows of its key older than the asker and newer than ``since_us`` (null: all).
    """
    row = rows.select(*keys, F.col("t_us").alias("t"), "id", F.lit(ROW).alias("kind"), F.lit(None).cast("string").alias("asker"))
    # Just before the asker itself; just after all rows of the moment the period begins at.
    end = probes.select(*keys, F.col("t_us").alias("t"), F.col("asker").alias("id"), F.lit(BEFORE).alias("kind"), "asker")
    start = probes.select(*keys, F.coalesce("since_us", F.lit(-(1 << 62))).alias("t"), F.lit("").alias("id"), F.lit(AFTER).alias("kind"), "asker")
    # At one moment larger ids stand first; the empty id of a start stands behind them all.
    order = [*[F.col(k).asc() for k in keys], F.col("t").asc(), F.col("id").desc(), F.col("kind").asc()]
    placed = cut(running_count(row.unionByName(end).unionByName(start), order, F.col("kind") == ROW))
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("pos")))
    found = placed.filter(F.col("kind") != ROW).groupBy("asker", *keys).agg((at(AFTER) + 1).alias("from_pos"), at(BEFORE).alias("to_pos")).filter("to_pos >= from_pos")
    return placed.filter(F.col("kind") == ROW).select("id", F.col("pos").alias(position)), found


@dataclass(frozen=True)
class NewsCandidates:
    """The tables of news with news. Those of keywords have a row for each article and group alike its own, so they are only worked out where they are asked for."""

    rows: DataFrame  # id, category, t_us, group_id
    alike: DataFrame  # set_a, set_b: groups alike
    counted: DataFrame  # id, keyword, less: older ones in groups alike, and those among them that the topic range holds; in several rows
    place: DataFrame  # id_a, id_b, one_topic: pairs, so worked out where they are used and not written
    hours: int

    def _probes(self, df: DataFrame, *keys: str, ever: bool = False) -> DataFrame:
        since = F.lit(None).cast("bigint") if ever else F.col("t_us") - self.hours * HOUR
        return df.select("asker", *keys, "t_us", since.alias("since_us"))

    @cached_property
    def _asked(self) -> DataFrame:
        own = self.rows.filter("group_id is not null").select(F.col("group_id").alias("a"), F.col("group_id").alias("b")).distinct()
        # Both directions, and each group with itself.
        routes = self.alike.union(self.alike.select("set_b", "set_a")).union(own).toDF("group_id", "other")
        return cut(self.rows.filter("group_id is not null").join(routes, "group_id").select(F.col("id").alias("asker"), "category", "t_us", F.col("other").alias("group_id")))

    @cached_property
    def _in_group(self) -> tuple[DataFrame, DataFrame]:
        return ranges(self.rows.filter("group_id is not null").select("id", "group_id", "t_us"), self._probes(self._asked, "group_id", ever=True), ["group_id"], "group_pos")

    @cached_property
    def _in_topic(self) -> tuple[DataFrame, DataFrame]:
        return ranges(self.rows.select("id", "category", "t_us"), self._probes(self.rows.withColumnRenamed("id", "asker"), "category"), ["category"], "topic_pos")

    @cached_property
    def _in_both(self) -> tuple[DataFrame, DataFrame]:
        return ranges(self.rows.filter("group_id is not null").select("id", "category", "group_id", "t_us"), self._probes(self._asked, "category", "group_id"), ["category", "group_id"], "topic_group_pos")

    @cached_property
    def members(self) -> DataFrame:
        """id, category, t_us, group_id, group_pos, topic_pos, topic_group_pos"""
        return cut(self.rows.join(self._in_group[0], "id", "left").join(self._in_topic[0], "id").join(self._in_both[0], "id", "left"))

    @property
    def keyword(self) -> DataFrame:
        """id, group_id, from_pos, to_pos"""
        return self._in_group[1].withColumnRenamed("asker", "id")

    @property
    def topic(self) -> DataFrame:
        """id, category, from_pos, to_pos"""
        return self._in_topic[1].withColumnRenamed("asker", "id")

    @property
    def topic_less(self) -> DataFrame:
        """id, category, group_id, from_pos, to_pos"""
        return self._in_both[1].withColumnRenamed("asker", "id")


def news_candidates(news: DataFrame, hours: int = TOPIC_HOURS) -> NewsCandidates:
    """Candidates of news with news. Input: id, category, t_us, lat, lng, keywords."""
    members, sets = keyword_sets(news)
    rows = saved(news.select("id", "category", "t_us").join(members.withColumnRenamed("set_id", "group_id"), "id", "left"))
    met = saved(groups_counted(rows, sets, hours))
    alike = met.filter("set_a is not null").select("set_a", "set_b")
    place = news_place_pairs(news, members, sets, alike, ("category",)).select("id_a", "id_b", F.col("category_a").eqNullSafe(F.col("category_b")).alias("one_topic"))
    return NewsCandidates(rows, alike, met.filter("id is not null").select("id", "keyword", "less"), place, hours)


def groups_counted(rows: DataFrame, sets: DataFrame, hours: int) -> DataFrame:
    """Groups alike (set_a, set_b) and, in rows of their own, what articles have in groups alike theirs: (id, keyword, less), see ``NewsCandidates.counted``.

    rows: id, category, t_us, group_id; sets: set_id, tokens. Two blocks of groups meet in a task together with their members, which are counted there: neither the pairs nor a row for each
    article and group are moved.
    """
    named = rows.filter("group_id is not null").select(F.col("group_id").alias("set_id"), "id", "category", "t_us").join(sets.select(F.col("set_id").alias("id"), "tokens"), "id", "left")
    met, n = in_blocks(named.select("set_id", "tokens", "id", "category", "t_us"))

    def counted(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        heads = block.filter(pc.is_valid(block.column("tokens"))).combine_chunks()
        a, b, _similarity = alike_in_block(heads, n, KEYWORD_JACCARD)
        names = heads.column("set_id")
        left, right = names.take(pa.array(a)), names.take(pa.array(b))
        swap = pc.greater(left, right)
        none = lambda type_, k: pa.nulls(k, type_)
        pairs = [pc.if_else(swap, right, left), pc.if_else(swap, left, right), none(pa.string(), len(a)), none(pa.int64(), len(a)), none(pa.int64(), len(a))]
        block = block.filter(pc.is_valid(block.column("t_us"))).combine_chunks()
        keyword, less = older_members(block, heads, a, b, n, hours)
        some = np.flatnonzero(keyword)
        counts = [none(pa.string(), len(some)), none(pa.string(), len(some)), block.column("id").take(pa.array(some)), pa.array(keyword[some]), pa.array(less[some])]
        columns = ["set_a", "set_b", "id", "keyword", "less"]
        return pa.concat_tables([pa.Table.from_arrays(x, names=columns) for x in (pairs, counts)])

    return met.applyInArrow(counted, "set_a string, set_b string, id string, keyword bigint, less bigint")


def older_members(block: pa.Table, heads: pa.Table, a: np.ndarray, b: np.ndarray, n: int, hours: int) -> tuple[np.ndarray, np.ndarray]:
    """For each article of a pair of blocks, how many older ones the groups alike its own hold there, and how many of them are of its category and of the period."""
    m = len(block)
    keyword, less = np.zeros(m, np.int64), np.zeros(m, np.int64)
    if not m:
        return keyword, less
    group = pc.index_in(block.column("set_id"), heads.column("set_id").combine_chunks()).to_numpy().astype(np.int64)
    time = block.column("t_us").cast(pa.int64()).to_numpy()
    kinds = pc.dictionary_encode(block.column("category"), null_encoding="encode").combine_chunks()
    kind, n_kinds = kinds.indices.to_numpy().astype(np.int64), len(kinds.dictionary)
    # From the oldest to the newest; at one moment larger ids stand first.
    order = pc.sort_indices(block, [("t_us", "ascending"), ("id", "descending")]).to_numpy().astype(np.int64)
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    since = np.searchsorted(time[order], time - hours * HOUR, "right")
    by_group, by_kind = np.sort(group * m + place), np.sort((group * n_kinds + kind) * m + place)
    listed = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[listed], np.arange(len(heads) + 1))
    own = np.arange(len(heads)) if len(set(divmod(block.column("pair")[0].as_py(), n))) == 1 else np.zeros(0, np.int64)
    x, y = np.concatenate([a, b, own]), np.concatenate([b, a, own])
    until, i = np.cumsum(begin[x + 1] - begin[x]), 0
    while i < len(x):
        k = max(i + 1, int(np.searchsorted(until, (until[i - 1] if i else 0) + MET_AT_ONCE, "right")))
        times = begin[x[i:k] + 1] - begin[x[i:k]]
        who = listed[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[x[i:k]], times)]
        other = np.repeat(y[i:k], times)
        older = np.searchsorted(by_group, other * m + place[who]) - begin[other]
        alike = (other * n_kinds + kind[who]) * m
        np.add.at(keyword, who, older)
        np.add.at(less, who, np.searchsorted(by_kind, alike + place[who]) - np.searchsorted(by_kind, alike + since[who]))
        i = k
    return keyword, less


def _size() -> Column:
    return F.col("to_pos") - F.col("from_pos") + 1


def candidate_counts(c: NewsCandidates) -> DataFrame:
    """Per article how many older ones each rule pairs it with first: id, keyword, place, topic."""
    part = lambda df, key, n, name: df.select(F.col(key).alias("id"), *[n.alias(k) if k == name else F.lit(0).cast("bigint").alias(k) for k in ("keyword", "place", "topic")])
    one = F.lit(1).cast("bigint")
    # Pairs are counted where they arise. Place pairs of one category all lie within the topic's period.
    place = c.place.groupBy(F.col("id_a").alias("id")).agg(F.lit(0).cast("bigint").alias("keyword"), F.count(F.lit(1)).alias("place"), (-F.count_if("one_topic")).alias("topic"))
    alike = c.counted.select("id", "keyword", F.lit(0).cast("bigint").alias("place"), (-F.col("less")).alias("topic"))
    parts = [alike, place, part(c.topic, "id", _size(), "topic"), part(c.rows, "id", one * 0, "topic")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(*[F.sum(k).alias(k) for k in ("keyword", "place", "topic")])


def candidates_of(c: NewsCandidates, ids: DataFrame) -> DataFrame:
    """The pairs (id_a, id_b, rule) of chosen articles with older ones. Input: id; as many pairs arise as the chosen articles have."""
    chosen = ids.select("id").distinct()
    every = lambda df: df.join(chosen, "id", "left_semi").withColumn("pos", F.explode(F.sequence("from_pos", "to_pos")))
    at = lambda *columns: c.members.select(F.col("id").alias("id_b"), *columns)
    keyword = every(c.keyword).join(at(F.col("group_pos").alias("pos")), "pos").select(F.col("id").alias("id_a"), "id_b")
    less = every(c.topic_less).join(at(F.col("topic_group_pos").alias("pos")), "pos").select(F.col("id").alias("id_a"), "id_b")
    place = c.place.select("id_a", "id_b").join(chosen.toDF("id_a"), "id_a", "left_semi")
    topic = every(c.topic).join(at(F.col("topic_pos").alias("pos")), "pos").select(F.col("id").alias("id_a"), "id_b")
    rest = topic.join(less.union(place), ["id_a", "id_b"], "left_anti")
    rule = lambda df, name: df.select("id_a", "id_b", F.lit(name).alias("rule"))
    return rule(keyword, "keyword").union(rule(place, "place")).union(rule(rest, "topic"))


# ---------------------------------------------------------------- news with disasters

@dataclass(frozen=True)
class DisasterCandidates:
    positions: DataFrame  # category, pos, id: disasters in the order (category, time, id)
    named: DataFrame  # news_id, category, from_pos, to_pos, n
    near: DataFrame  # news_id, disaster_id, t_us: near ones of kinds that the article does not name


def disaster_candidates(news: DataFrame, disasters: DataFrame, near: DataFrame, days: int = DISASTER_DAYS) -> DisasterCandidates:
    """Candidates of news with disasters of the week before. ``near``: news_id, disaster_id, mentions, t_us of the disaster (see ``pairs.news_disaster_pairs``)."""
    order = [F.col("category").asc(), F.col("t_us").asc(), F.col("id").asc()]
    positions = running_count(disasters.select("category", "t_us", "id"), order).select("category", "pos", "id")
    return DisasterCandidates(positions, mention_windows(news, disasters, days), near.filter(~F.col("mentions")).select("news_id", "disaster_id", "t_us"))


def candidate_runs(c: DisasterCandidates, size: int = BATCH) -> DataFrame:
    """All candidates of each article, numbered through: news_id, category, from_pos, first_no, n, first_batch, last_batch.

    The ranges of named kinds come first, by kind, then (kind null) the near ones, newest first. Candidate number ``first_no + i`` of a run is position ``from_pos + i``;
    a batch holds ``size`` consecutive numbers, so a run need not be expanded to say what is in which batch.
    """
    unnamed = c.near.groupBy("news_id").agg(F.count(F.lit(1)).alias("n")).select("news_id", F.lit(None).cast("string").alias("category"), F.lit(None).cast("bigint").alias("from_pos"), "n")
    runs = c.named.select("news_id", "category", "from_pos", "n").unionByName(unnamed)
    # At most one run per kind of disaster and one more.
    listed = runs.groupBy("news_id").agg(F.array_sort(F.collect_list(F.struct(F.col("category").isNull().alias("last"), "category", "from_pos", "n"))).alias("runs"))
    before = lambda i: F.aggregate(F.slice("runs", 1, i), F.lit(0).cast("bigint"), lambda s, r: s + r["n"])
    numbered = listed.select("news_id", F.inline(F.transform("runs", lambda r, i: F.struct(r["category"].alias("category"), r["from_pos"].alias("from_pos"), before(i).alias("first_no"), r["n"].alias("n")))))
    return numbered.withColumns({"first_batch": F.floor(F.col("first_no") / size), "last_batch": F.floor((F.col("first_no") + F.col("n") - 1) / size)})


def batches_of(c: DisasterCandidates, ids: DataFrame, size: int = BATCH) -> DataFrame:
    """(news_id, batch, no, disaster_id) of chosen articles. Input: news_id."""
    runs = candidate_runs(c, size).join(ids.select("news_id").distinct(), "news_id", "left_semi")
    named = runs.filter("category is not null").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    named = named.withColumn("pos", F.col("from_pos") + F.col("i")).join(c.positions.select("pos", F.col("id").alias("disaster_id")), "pos").select("news_id", (F.col("first_no") + F.col("i")).alias("no"), "disaster_id")
    ranked = c.near.join(runs.filter("category is null").select("news_id", "first_no"), "news_id").groupBy("news_id", "first_no").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("t_us")).alias("newest"), "disaster_id"))).alias("l"))
    near = ranked.select("news_id", "first_no", F.posexplode("l").alias("i", "x")).select("news_id", (F.col("first_no") + F.col("i")).alias("no"), F.col("x.disaster_id").alias("disaster_id"))
    return named.unionByName(near).withColumn("batch", F.floor(F.col("no") / size))
