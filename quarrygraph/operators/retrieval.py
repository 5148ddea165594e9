"""Lexical ranking, blending with graph rank, file ranking, fusion across scopes and selection.

Documents are ``(id, name, path, body)``; the index is three tables: ``postings(id, field, token, tf)``,
``df(token, df)`` and one row ``(docs, average)``. All aggregates are partial before their shuffle; a query's terms are
a literal array, so ranking scans the postings with one pushed-down filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygraph.functions import text as T
from quarrygraph.plans.shared import cut

#: Fixed values of fusion.
RRF_K, PARTICIPATION, STRONG_FLOOR, HIGH_FLOOR = 60, 0.25, 0.1, 0.5


#: Directories of a saved index.
BUCKETS = 64


@dataclass
class Index:
    postings: DataFrame
    df: DataFrame
    stats: DataFrame
    lengths: DataFrame

    def of(self, terms: list[str]) -> DataFrame:
        """The postings of some terms; of a saved index only their buckets are read."""
        hit = self.postings.where(F.col("token").isin(terms))
        return hit.where(F.col("bucket").isin([_bucket(F.lit(t)) for t in terms])).drop("bucket") if "bucket" in hit.columns else hit

    def save(self, path: str) -> None:
        """Postings lie in buckets of their token, so that a query reads few files. They are dealt by ranges down to the
        id, so a common token is spread over tasks and a bucket over files."""
        dealt = self.postings.withColumn("bucket", _bucket(F.col("token"))).repartitionByRange("bucket", "token", "id").sortWithinPartitions("bucket", "token")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.df.write.mode("overwrite").parquet(f"{path}/df")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @staticmethod
    def load(spark, path: str) -> Index:
        postings = spark.read.schema("id string, field string, token string, tf bigint, bucket bigint").parquet(f"{path}/postings")
        return Index(postings, *(spark.read.parquet(f"{path}/{name}") for name in ("df", "stats", "lengths")))


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS))


def build_index(docs: DataFrame, fields: tuple[str, ...] = ("name", "path", "body")) -> Index:
    """Term frequencies by field, document frequencies over all fields, lengths of bodies and their average. Tokens are
    filtered after they are exploded, in compiled code; a query's terms filter them there too."""
    pieces = docs.select("id", *[T.raw_tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"{f}_pieces") for f in dict.fromkeys((*fields, "body"))])
    # texts are split once, here; all tables below read the pieces
    pieces = cut(pieces.withColumn("length", F.size(T.only_tokens(F.col("body_pieces"))).cast("bigint")), "pieces")
    raw = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_pieces").alias("tokens")) for f in fields])
    bags = pieces.select("id", F.explode(raw).alias("b")).select("id", "b.field", F.explode("b.tokens").alias("token")).where(T.is_token(F.col("token")))
    postings = bags.groupBy("id", "field", "token").agg(F.count("*").alias("tf"))
    union = F.array_distinct(F.flatten(F.array(*[F.col(f"{f}_pieces") for f in fields])))
    df = pieces.select(F.explode(union).alias("token")).where(T.is_token(F.col("token"))).groupBy("token").agg(F.count("*").alias("df"))
    lengths = pieces.select("id", "length")
    stats = lengths.agg(F.count("*").alias("docs"), F.avg(F.col("length").cast("double")).alias("average"))
    return Index(postings, df, stats, lengths)


def query_terms(query: str) -> list[str]:
    import re

    spaced = re.sub("([a-z0-9])([A-Z])", r"\1 \2", query).lower()
    return list(dict.fromkeys(t for t in re.split("[^a-z0-9]+", spaced) if len(t) > 1 and t not in T.STOP_WORDS))


def query_weights(index: Index, query: str) -> DataFrame:
    """``(term, idf, weight)``: the query's terms; weights sum to 1, unseen terms count as in no document."""
    spark = index.df.sparkSession
    terms = spark.createDataFrame([(t,) for t in query_terms(query)], "term string")
    known = terms.join(index.df.where(F.col("token").isin(query_terms(query))), F.col("term") == F.col("token"), "left").crossJoin(F.broadcast(index.stats))  # one row
    out = known.select("term", T.idf(F.col("docs"), F.coalesce("df", F.lit(0))).alias("idf"))
    return out.withColumn("weight", F.col("idf") / F.sum("idf").over(Window.partitionBy()))  # a query's few terms


def lexical(index: Index, query: str, paths: DataFrame | None = None) -> DataFrame:
    """``(id, lexical, terms)``: name x 3 + path x 2 + BM25 of the body, terms matched; positive scores only. With
    ``paths(id, path)`` test paths are penalised unless the query asks for tests."""
    terms = query_terms(query)
    hit = index.of(terms)
    df = index.df.where(F.col("token").isin(terms))  # at most the query's terms
    scored = hit.join(F.broadcast(df), "token").crossJoin(F.broadcast(index.stats)).join(index.lengths, "id", "left")
    idf = T.idf(F.col("docs"), F.col("df"))
    part = F.when(F.col("field") == "name", T.NAME_WEIGHT * F.col("tf") * idf).when(F.col("field") == "path", T.PATH_WEIGHT * F.col("tf") * idf).otherwise(T.bm25(F.col("tf"), idf, F.coalesce("length", F.lit(0)), F.col("average")))
    out = scored.groupBy("id").agg(F.sum(part).alias("lexical"), F.array_sort(F.collect_set("token")).alias("terms"))
    if paths is not None:
        wants = any(t in ("test", "tests", "testing", "spec") for t in terms)
        out = out.join(paths.select("id", "path"), "id").withColumn("lexical", F.col("lexical") * T.test_factor(F.col("path"), wants)).drop("path")
    return out.where("lexical > 0")


def matched_share(index: Index, query: str, ids: DataFrame, fields: tuple[str, ...] = ("name", "path", "body")) -> DataFrame:
    """``(id, share)``: idf-weighted share of the query's terms that occur in the fields, plural and singular alike."""
    terms = query_weights(index, query)
    s = F.lit("s")
    forms = terms.select("term", "weight", F.explode(F.array_distinct(F.array("term", F.concat("term", s), F.when(F.col("term").endswith("s"), F.expr("substr(term, 1, length(term) - 1)")).otherwise(F.col("term"))))).alias("token"))
    hit = index.postings.where(F.col("field").isin(*fields)).join(F.broadcast(forms), "token").select("id", "term", "weight").distinct()
    return ids.select("id").join(hit.groupBy("id").agg(F.sum("weight").alias("share")), "id", "left").select("id", F.coalesce("share", F.lit(0.0)).alias("share"))


def blend(lexical_: DataFrame, rank: DataFrame, factor: DataFrame | None = None) -> DataFrame:
    """``(id, lexical, graph, score)``: lexical by its maximum plus half the graph rank, times the path's factor; ids
    without a lexical score join from a graph rank of 0.15."""
    top = lexical_.agg(F.max("lexical").alias("top"))
    near = rank.select("id", F.col("rank").alias("graph"))
    both = lexical_.select("id", "lexical").join(near, "id", "full_outer").where((F.col("lexical").isNotNull()) | (F.col("graph") >= T.RESCUE_FLOOR))
    both = both.crossJoin(F.broadcast(top)).select("id", F.coalesce(F.col("lexical") / F.col("top"), F.lit(0.0)).alias("lexical"), F.coalesce("graph", F.lit(0.0)).alias("graph"))
    score = F.col("lexical") + T.GRAPH_WEIGHT * F.col("graph")
    if factor is not None:
        both = both.join(factor.select("id", "factor"), "id", "left")
        score = score * F.coalesce("factor", F.lit(1.0))
    return both.withColumn("score", score).select("id", "lexical", "graph", "score").where("score > 0")


def participating(docs: DataFrame) -> DataFrame:
    """``(scope, best)`` of the scopes whose best score reaches a quarter of the best of all."""
    best = docs.where("score > 0").groupBy("scope").agg(F.max("score").alias("best"))
    top = best.agg(F.max("best").alias("top"))
    return best.crossJoin(F.broadcast(top)).where(F.col("best") >= PARTICIPATION * F.col("top")).select("scope", "best")


def fuse_ranks(docs: DataFrame) -> DataFrame:
    """``(id, scope, score)``: reciprocal rank fusion over the participating scopes of ``docs(id, scope, score)``; an id
    belongs to the scope where it ranks best; the largest score is 1. A lone scope keeps its scores."""
    positive = docs.where("score > 0")
    scopes = participating(docs)
    lone = docs.where("score > 0").agg((F.count_distinct("scope") == 1).alias("lone"))
    ranked = positive.join(scopes, "scope").withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy(F.col("score").desc(), "id")))
    best = F.struct(F.col("place"), (-F.col("best")).alias("b"), F.col("scope"))
    fused = ranked.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("place"))).alias("rrf"), F.min(best)["scope"].alias("scope"), F.max("score").alias("own"))
    top = fused.agg(F.max("rrf").alias("top"))
    return fused.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(lone)).select("id", "scope", F.when(F.col("lone"), F.col("own")).otherwise(F.col("rrf") / F.col("top")).alias("score"))


def combine_scores(docs: DataFrame) -> DataFrame:
    """``(id, scope, score)``: each id's best score among the participating scopes, by the largest of all; of equal scores
    the scope with the better best counts, then the first in order. A lone scope keeps its scores."""
    scopes = participating(docs)
    lone = docs.where("score > 0").agg((F.count_distinct("scope") == 1).alias("lone"))
    kept = docs.where("score > 0").join(scopes, "scope")
    first = F.struct((-F.col("score")).alias("s"), (-F.col("best")).alias("b"), F.col("scope"))
    best = kept.groupBy("id").agg(F.max("score").alias("own"), F.min(first)["scope"].alias("scope"))
    top = best.agg(F.max("own").alias("top"))
    return best.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(lone)).select("id", "scope", F.when(F.col("lone"), F.col("own")).otherwise(F.col("own") / F.col("top")).alias("score"))


def round_robin(ranked: DataFrame, group: str, place: str, limit: int) -> DataFrame:
    """Each group's first item in order of their places, then each one's second, and so on; ``position`` from 1."""
    w = Window.partitionBy(group)
    depth = ranked.withColumn("depth", F.row_number().over(w.orderBy(place))).withColumn("lead", F.min(place).over(w))
    top = depth.orderBy("depth", "lead").limit(limit)
    return top.withColumn("position", F.row_number().over(Window.partitionBy().orderBy("depth", "lead")))  # at most limit rows


def top_lock(ranked: DataFrame, winner: Column, place: str) -> DataFrame:
    """Moves what ``winner`` holds for to the front and leaves the order of the rest."""
    return ranked.withColumn("locked", winner).orderBy(F.col("locked").desc(), place)


def rank_files(candidates: DataFrame, weights: DataFrame) -> DataFrame:
    """``(file, representative, score, union_coverage, anchor_coverage, residual)`` of ``candidates(id, file, kind,
    raw_lexical, lexical, graph, factor, baseline, terms, eligible)`` and ``weights(term, weight)``.

    The anchor is a file's symbol of the highest raw lexical score; what the file's other symbols cover beyond it adds
    a bounded residual to its lexical score. The file takes the better of that and its best baseline.
    """
    good = candidates.where((F.col("file") != "") & (F.col("baseline") > 0))
    terms = F.broadcast(weights)  # a query's few terms
    covered = good.select("id", "file", F.explode("terms").alias("term")).join(terms, "term").groupBy("file", "id").agg(F.sum("weight").alias("coverage"))
    good = good.join(covered, ["file", "id"], "left").withColumn("coverage", F.least(F.lit(1.0), F.coalesce("coverage", F.lit(0.0))))
    donor = (F.col("kind") == "symbol") & F.col("eligible") & (F.col("raw_lexical") > 0) & (F.col("lexical") > 0)
    donors = good.where(donor)
    first = Window.partitionBy("file").orderBy(F.col("raw_lexical").desc(), F.col("coverage").desc(), "id")
    anchor = donors.withColumn("n", F.row_number().over(first)).where("n = 1").select("file", F.col("id").alias("anchor"), T.clamp01(F.col("lexical")).alias("al"), T.clamp01(F.col("graph")).alias("ag"), T.clamp01(F.col("factor")).alias("af"), F.col("coverage").alias("anchor_coverage"))
    union = donors.select("file", F.explode("terms").alias("term")).distinct().join(terms, "term").groupBy("file").agg(F.least(F.lit(1.0), F.sum("weight")).alias("union_coverage"))
    best = good.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.col("baseline").desc(), F.col("raw_lexical").desc(), "id"))).where("n = 1").select("file", "id", "baseline")
    j = best.join(anchor, "file", "left").join(union, "file", "left")
    u, a = F.coalesce("union_coverage", F.lit(0.0)), F.coalesce("anchor_coverage", F.lit(0.0))
    residual = F.when(u > 0, T.clamp01(a * F.greatest(F.lit(0.0), u - a) / u)).otherwise(0.0)
    j = j.withColumn("residual", residual).withColumn("pooled", F.col("af") * (T.clamp01(F.col("al") + (1 - F.col("al")) * F.col("residual")) + 0.5 * F.col("ag")))
    wins = F.coalesce(F.col("pooled") > F.col("baseline"), F.lit(False))
    return j.select("file", F.when(wins, F.col("anchor")).otherwise(F.col("id")).alias("representative"), F.when(wins, F.col("pooled")).otherwise(F.col("baseline")).alias("score"), u.alias("union_coverage"), a.alias("anchor_coverage"), "residual")


def top_hits(scored: DataFrame, limit: int = 8, score: str = "score", tie: str = "id") -> DataFrame:
    return scored.orderBy(F.col(score).desc(), tie).limit(limit)
