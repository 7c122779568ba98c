"""Claim frames: quality, normal forms, checks against evidence, search and
alignment across documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lexforge.functions import frame_terms as C
from lexforge.functions import text as T
from lexforge.operators.containment import Finder
from lexforge.operators.facts import first_match
from lexforge.operators.lexical import ranked


def quality_score(claim: Column, n_units: Column, source: Column, kind: Column, confidence: Column) -> Column:
    noise = F.size(T.noise_reasons(claim, source=source))
    score = (
        F.lit(0.5)
        + 0.2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.6))))
        + F.when(n_units > 0, 0.18).otherwise(-0.22)
        + F.when(source.isin("claim", "innovation"), 0.08).otherwise(0.0)
        - F.when(source.isin("table_summary", "citation_map") & (n_units == 0), 0.12).otherwise(0.0)
        - F.when(kind == "citation", 0.04).otherwise(0.0)
        + F.when(T.research_signal(claim), 0.08).otherwise(-0.08)
        - F.least(F.lit(0.3), 0.12 * noise)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def quality_level(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= C.LOW_QUALITY, "medium").otherwise("low")


def normalized(frames: DataFrame, families: dict[str, list[str]] | None = None, metrics: list[str] | None = None, negative: list[str] | None = None, positive: list[str] | None = None) -> DataFrame:
    """Adds normalized_subject, method_family, metric, condition, polarity."""
    families, metrics = families or C.FAMILIES, metrics or C.METRICS
    text = F.concat_ws(" ", *[T.text_of(f) for f in C.FIELDS])
    subject = F.coalesce(*[F.nullif(T.excerpt(T.text_of(f), 120), F.lit("")) for f in ("problem", "method", "short_claim")], F.lit(""))
    raw = F.lower(F.when(T.text_of("method") != "", T.text_of("method")).otherwise(text))
    family = first_match(raw, {k: [t.lower() for t in v] for k, v in families.items()}, "")
    family = F.when((family == "") & (F.col("claim_type") == "method"), "method_unspecified").otherwise(family)
    value = F.lower(F.when(T.text_of("metric_or_signal") != "", T.text_of("metric_or_signal")).otherwise(text))
    hits = F.filter(T.lit_array(metrics), lambda m: F.contains(value, F.lower(m)))
    whole = T.let(hits, lambda h: F.filter(h, lambda m: ~F.exists(h, lambda o: (o != m) & F.contains(o, m))))
    polarity = F.when(F.col("claim_type") == "limitation", "negative").when(T.any_term(text, negative or C.NEGATIVE), "negative").when(T.any_term(text, positive or C.POSITIVE), "positive").otherwise("neutral")
    return frames.withColumns({"normalized_subject": subject, "method_family": family, "metric": F.array_join(F.slice(whole, 1, 6), "、"), "condition": T.text_of("dataset_or_setting"), "polarity": polarity})


def allows_weak(query: Column) -> Column:
    return T.any_term(F.lower(T.compact(query)), C.WEAK_QUERY)


def base_score(weak: bool, support: Column, semantic: Column) -> Column:
    """What a frame scores without a hit, for queries that tolerate weak frames
    or not; null where such a query leaves the frame out."""
    quality = F.coalesce(F.col("quality_score"), F.lit(0.6))
    score = 0.2 * F.col("n_units") + 0.3 * F.coalesce(F.col("confidence"), F.lit(0.0)) + 0.5 * quality
    score = score + F.when(support == "structurally_supported", 0.4).when(support == "unchecked", 0.15).when(support == "unsupported", -0.3 if weak else -1.2).otherwise(0.0)
    extra = F.lit(0.0)
    for status, pair in C.SUPPORT.items():
        extra = F.when(semantic == status, pair[weak]).otherwise(extra)
    score = score + extra - 0.3 * F.coalesce(F.col("n_noise"), F.lit(0))
    return score if weak else F.when(~((quality < C.MIN_QUALITY) | (support == "unsupported")), score)


#: Frames scored at a time.
STRIP = 2048


def _blocks(asked: DataFrame, block: int) -> Iterator[list]:
    """Rows of a stated set of queries, ``block`` at a time, in order."""
    held: list = []
    for row in asked.orderBy("query_id").toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def search(queries: DataFrame, frames: DataFrame, k: int = 8, block: int = 1000) -> DataFrame:
    """(query_id, rank, frame_id, score): the best ``k`` frames of each query.

    Queries are a stated set and go to the frames in blocks of at most ``block``.
    A task finds all terms of a block in its frames with one automaton, which
    gives a matrix of frames by terms, and multiplies it with the terms by
    queries; it passes on the best ``k`` of each query among ``STRIP`` frames,
    so what is shuffled does not grow with the number of matches.
    """
    asked = queries.select("query_id", T.frame_terms(T.text_of("query")).alias("terms"), allows_weak(T.text_of("query")).alias("weak"))
    support, semantic = F.col("support_status"), F.col("semantic_support_status")
    source = frames.select("frame_id", base_score(False, support, semantic).cast("double").alias("usual"), base_score(True, support, semantic).cast("double").alias("tolerant"), *[F.lower(T.text_of(f)).alias(f) for f in C.FIELDS])
    kinds = {"q": queries.schema["query_id"].dataType, "f": frames.schema["frame_id"].dataType}
    spark, weights = frames.sparkSession, list(C.FIELDS.values())

    def best(part: list) -> DataFrame:
        words = sorted({t.lower() for r in part for t in r["terms"] if t})
        at = {w: n for n, w in enumerate(words)}
        rows, columns = [], []
        for n, r in enumerate(part):
            for t in r["terms"]:
                if t:
                    rows.append(at[t.lower()])
                    columns.append(n)
        always = [sum(t == "" for t in r["terms"]) for r in part]  # an empty term is in every field
        sent = spark.sparkContext.broadcast((words, rows, columns, [r["weak"] for r in part], always))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, rows, columns, weak, always = sent.value
            finder = Finder(words)
            asked_by = np.zeros((len(words), len(weak)))
            np.add.at(asked_by, (rows, columns), 1.0)
            weak, always = np.array(weak), np.array(always) * sum(weights)
            for whole in batches:
                for start in range(0, whole.num_rows, STRIP):
                    batch = whole.slice(start, STRIP)
                    hits = np.zeros((batch.num_rows, len(words)))
                    for weight, field in zip(weights, batch.columns[3:]):
                        for n, text in enumerate(field.to_pylist()):
                            if text:
                                hits[n, finder.find(text)] += weight
                    base = np.where(weak[None, :], *(batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in (2, 1)))
                    score = hits @ asked_by + base + always[None, :]
                    order = np.round(np.where(score > 0, score, -np.inf), 6)  # left out: null, hence nan
                    ids = np.array(batch.column(0).to_pylist(), dtype=object)
                    out_q, out_f, out_s = [], [], []
                    for q in range(len(weak)):
                        found = np.flatnonzero(order[:, q] > -np.inf)
                        if len(found) > k:
                            found = found[order[found, q] >= np.partition(order[found, q], -k)[-k]]
                        found = sorted(found.tolist(), key=lambda n: (-order[n, q], ids[n]))[:k]
                        out_q += [q] * len(found)
                        out_f += ids[found].tolist()
                        out_s += score[found, q].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int32()), pa.array(out_f, batch.schema.field(0).type), pa.array(out_s, pa.float64())], names=["_n", "frame_id", "score"])

        names = spark.createDataFrame([(n, r["query_id"]) for n, r in enumerate(part)], StructType([StructField("_n", IntegerType()), StructField("query_id", kinds["q"])]))
        scored = source.mapInArrow(run, StructType([StructField("_n", IntegerType()), StructField("frame_id", kinds["f"]), StructField("score", DoubleType())])).join(F.broadcast(names), "_n")
        return ranked(scored, k, F.round("score", 6).desc(), F.col("frame_id")).select("query_id", "rank", "frame_id", F.round("score", 3).alias("score"))

    made = [best(part) for part in _blocks(asked, block)]
    return reduce(DataFrame.unionByName, made or [best([])])


def semantic_terms(c: Column, stop: list[str] | None = None) -> Column:
    found = T.terms(c, cjk_min=4, limit=16)
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~F.array_contains(T.lit_array(stop or C.SEMANTIC_STOP), F.lower(t)))


def claim_text(frames: DataFrame) -> Column:
    """All fields of a claim that a table has, as one text."""
    return T.compact(F.concat_ws(" ", *[T.text_of(f) for f in C.FIELDS if f in frames.columns]))


def core_terms(frames: DataFrame, claim: Column) -> Column:
    """The terms of the fields that matter for a claim's type, or else its first eight."""
    found = F.array().cast("array<string>")
    for kind, fields in C.CORE_FIELDS.items():
        text = F.concat_ws(" ", *[T.text_of(f) for f in fields if f in frames.columns])
        found = F.when(F.col("claim_type") == kind, semantic_terms(text)).otherwise(found)
    return T.let(found, lambda v: F.when(F.size(v) > 0, v).otherwise(F.slice(claim, 1, 8)))


#: Bytes of units that a task checks frames against.
SUPPORT_BYTES = 8 << 20


def semantic_support(frames: DataFrame, units: DataFrame, conflict: list[str] | None = None, on: str = "doc_id") -> DataFrame:
    """Checks frames against the evidence units of their document.

    ``frames`` has frame_id, ``on``, claim_type and fields of the claim;
    ``units`` has ``on``, unit_id, unit, confidence. Returns one row for each
    frame of a document: status, score, the citation risk and the unit ids that are primary,
    weak and contradictory.

    Terms of either side are found once. Frames and units go to their document
    with no more than their terms, in one shuffle; a frame meets the units that
    share a term with it there, and is judged there. A unit that shares none
    scores a tenth of its confidence, so of those the most confident one of a
    document stands for all. A frame that comes twice in a document counts once.
    """
    words = conflict or C.CONFLICT
    # fields and their terms are columns before they are used, so that each is found once
    claims = frames.withColumn("_text", claim_text(frames)).withColumn("_c", semantic_terms(F.col("_text")))
    claims = claims.withColumn("_k", core_terms(frames, F.col("_c"))).withColumn("_terms", F.array_union("_c", "_k"))
    claims = claims.select(
        on, "frame_id", F.lit(False).alias("_unit"), "_terms", F.size("_c").alias("_nc"), F.size("_k").alias("_nk"), F.transform("_terms", lambda t: F.array_contains("_k", t)).alias("_in_k"),
        F.coalesce((F.col("claim_type") != "limitation") & ~T.any_term(F.lower("_text"), words), F.lit(False)).alias("_open"), (F.col("_text") == "").alias("_empty"),
    )
    there = units.filter(F.col("unit_id").isNotNull() & F.col(on).isNotNull())
    there = there.select(on, "unit_id", F.lit(True).alias("_unit"), semantic_terms(T.text_of("unit")).alias("_terms"), F.coalesce("confidence", F.lit(0.6)).cast("double").alias("confidence"), T.any_term(F.lower(T.text_of("unit")), words).alias("_against"), F.octet_length("unit").alias("_bytes"))
    size = there.agg(F.sum("_bytes")).first()[0] or 0
    parts = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SUPPORT_BYTES))
    both = claims.unionByName(there.drop("_bytes"), allowMissingColumns=True).repartition(parts, on)
    document = Window.partitionBy(on)
    both = both.withColumns({"_n": F.row_number().over(Window.partitionBy(on, "_unit", "frame_id").orderBy(F.lit(1))), "units": F.count(F.when(F.col("_unit"), 1)).over(document), "most": F.max("confidence").over(document)})
    # every frame also has the term null, which no unit has, so that it stays without a hit
    entries = F.transform("_terms", lambda t, i: F.struct(t.alias("term"), (i < F.col("_nc")).cast("int").alias("_in_c"), F.get("_in_k", i).cast("int").alias("_in_k")))
    null = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("_in_c"), F.lit(0).alias("_in_k")))
    own = [on, "_unit", "frame_id", "_nc", "_nk", "_open", "_empty", "units", "most", "unit_id", "confidence", "_against"]
    dealt = both.filter(F.col("_unit") | (F.col("_n") == 1)).select(*own, F.explode(F.when(F.col("_unit"), entries).otherwise(F.concat(entries, null))).alias("_e")).select(*own, "_e.*")
    claim = F.struct("frame_id", "_nc", "_nk", "_open", "_empty", "units", "most", "_in_c", "_in_k")
    met = dealt.groupBy(on, "term").agg(F.collect_list(F.when(~F.col("_unit"), claim)).alias("f"), F.collect_list(F.when(F.col("_unit"), F.struct("unit_id", "confidence", "_against"))).alias("u"))
    met = met.filter(F.col("term").isNull() | (F.size("u") > 0)).select(on, "term", "u", F.explode("f").alias("f")).select(on, "term", "f.*", F.explode_outer("u").alias("u")).select(on, "term", "u.*", "frame_id", "_nc", "_nk", "_open", "_empty", "units", "most", "_in_c", "_in_k")
    generic = F.array_contains(T.lit_array(C.GENERIC), F.lower("term"))
    hits = met.groupBy(on, "frame_id", "unit_id").agg(
        F.sum("_in_c").alias("_h"), F.sum("_in_k").alias("_s"), F.sum(F.when(generic, 0).otherwise(F.col("_in_k"))).alias("_p"), F.max(F.col("_open") & F.col("_against")).alias("_x"),
        *[F.max(c).alias(c) for c in ("_nc", "_nk", "confidence", "_empty", "units", "most")],
    )
    cover, core_cover = F.col("_h") / F.greatest(F.lit(1), "_nc"), F.col("_s") / F.greatest(F.lit(1), "_nk")
    score = F.when(F.col("unit_id").isNotNull(), F.least(F.lit(1.0), 0.55 * cover + 0.35 * core_cover + 0.10 * F.col("confidence")))
    rows = hits.withColumns({"_score": score, "_cc": core_cover})
    primary = (F.col("_score") >= 0.5) & ((F.col("_s") > 0) | (F.col("_h") >= 3))
    ids = lambda c: F.slice(F.array_sort(F.collect_set(F.when(c, F.col("unit_id")))), 1, 8)
    out = rows.groupBy(on, "frame_id").agg(
        F.max("_score").alias("best"), F.max(F.when(F.col("_x"), F.col("_score"))).alias("best_conflict"), F.max("_cc").alias("core_cover"), F.max("_p").alias("core_hits"),
        ids(primary).alias("primary"), ids(~primary).alias("weak"), ids(F.col("_x")).alias("contradictory"), *[F.max(c).alias(c) for c in ("_empty", "_nc", "units", "most")],
    )
    out = out.withColumn("best", F.greatest("best", 0.1 * F.col("most")))
    status = (
        F.when(F.col("_empty"), "not_checked")
        .when(F.col("units") == 0, "insufficient_evidence")
        .when(F.col("_nc") == 0, "not_checked")
        .when(F.size("contradictory") > 0, "contradicted")
        .when((F.size("primary") > 0) & (F.col("best") >= 0.58) & (F.col("core_cover") >= 0.65) & (F.col("core_hits") >= 2), "semantically_supported")
        .when((F.size("primary") > 0) | (F.col("core_hits") > 0), "partially_supported")
        .when(F.size("weak") > 0, "related_only")
        .otherwise("insufficient_evidence")
    )
    out = out.withColumn("status", status)
    value = F.when(F.col("status") == "contradicted", F.col("best_conflict")).when(F.col("status").isin("not_checked", "insufficient_evidence"), 0.0).otherwise(F.col("best"))
    # a contradiction names only what contradicts, and what is merely related has no primary evidence
    shown = {"primary": ["semantically_supported", "partially_supported"], "weak": ["semantically_supported", "partially_supported", "related_only"], "contradictory": ["contradicted"]}
    ids_of = [F.when(F.col("status").isin(s), F.array_join(c, ",")).otherwise("").alias(c) for c, s in shown.items()]
    return out.select("frame_id", "status", F.round(F.round(value, 9), 3).alias("score"), risk(F.col("status")).alias("citation_risk"), *ids_of)


def risk(status: Column) -> Column:
    out = F.lit("not_checked")
    for s, r in C.RISK.items():
        out = F.when(status == s, r).otherwise(out)
    return out


def overlap(a: Column, b: Column) -> Column:
    """Shared terms over the smaller set; 0 if either is empty."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(0.0)


def align_score(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Weighted similarity of two claims: type, fields, subject, method family."""
    parts = [F.when((F.size(x[f]) > 0) & (F.size(y[f]) > 0), overlap(x[f], y[f])) for f in ("setting_terms", "metric_terms")]
    n = reduce(lambda a, p: a + p.isNotNull().cast("int"), parts, F.lit(0))
    field = F.when(n > 0, reduce(lambda a, p: a + F.coalesce(p, F.lit(0.0)), parts, F.lit(0.0)) / n).otherwise(0.0)
    family = F.when((x["method_family"] != "") & (x["method_family"] == y["method_family"]), 1.0).otherwise(0.0)
    return C.ALIGN["type"] * (x["claim_type"] == y["claim_type"]).cast("int") + C.ALIGN["field"] * field + C.ALIGN["subject"] * overlap(x["subject_terms"], y["subject_terms"]) + C.ALIGN["family"] * family


def align(claims: DataFrame, threshold: float = C.ALIGN_THRESHOLD, most: int = 20_000) -> DataFrame:
    """Groups claims of one query and type: (query_id, claim_type, frame_id, grp).

    Claims are taken in order of ``position``; each joins the group whose best
    member is most like it, if that is like enough, else it opens one. What a
    claim joins depends on those before it, so this is done group by group, in
    one task for each query and type. Claims that share no term, metric,
    setting or method family with another cannot reach the threshold with it
    unless the type alone does, so members are looked up by what they share.
    More than ``most`` claims of one query and type raise an error.
    """
    schema = claims.select("query_id", "claim_type", "frame_id").schema.simpleString()[7:-1].replace(":", " ") + ", grp int"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > most:
            raise ValueError(f"{len(frame)} claims of one query and type; at most {most} can be aligned")
        frame = frame.sort_values(["position", "frame_id"], kind="stable")
        rows = [{"m": set(m), "s": set(s), "t": set(t), "f": f or ""} for m, s, t, f in zip(frame["metric_terms"], frame["setting_terms"], frame["subject_terms"], frame["method_family"])]
        where: dict[tuple[str, str], list[int]] = {}
        group: list[int] = []
        n = 0
        for k, row in enumerate(rows):
            keys = [*(("m", x) for x in row["m"]), *(("s", x) for x in row["s"]), *(("t", x) for x in row["t"]), *([("f", row["f"])] if row["f"] else [])]
            near = {j for key in keys for j in where.get(key, ())}
            best, at = 0.0, -1
            for j in sorted(near):
                score = _similar(row, rows[j])
                if score > best or (score == best and at >= 0 and group[j] < group[at]):
                    best, at = score, j
            if at >= 0 and best >= threshold:
                group.append(group[at])
            else:
                group.append(n)
                n += 1
            for key in keys:
                where.setdefault(key, []).append(k)
        return frame[["query_id", "claim_type", "frame_id"]].assign(grp=pd.Series(group, index=frame.index, dtype="int32"))

    return claims.groupBy("query_id", "claim_type").applyInPandas(run, schema)


def _similar(a: dict, b: dict) -> float:
    over = lambda x, y: len(x & y) / min(len(x), len(y)) if x and y else 0.0
    fields = [over(a[f], b[f]) for f in ("s", "m") if a[f] and b[f]]
    field = sum(fields) / len(fields) if fields else 0.0
    return C.ALIGN["type"] + C.ALIGN["field"] * field + C.ALIGN["subject"] * over(a["t"], b["t"]) + C.ALIGN["family"] * (1.0 if a["f"] and a["f"] == b["f"] else 0.0)


def relations(claims: DataFrame, groups: DataFrame, per_group: int = 6) -> DataFrame:
    """Typed relations of claims of different documents in one group, the
    ``per_group`` most alike of each group."""
    rows = claims.join(groups, ["query_id", "claim_type", "frame_id"])
    side = lambda p: rows.select("query_id", "claim_type", "grp", *[F.col(c).alias(f"{p}_{c}") for c in ("frame_id", "doc_id", "position", "metric_terms", "setting_terms", "subject_terms", "method_family", "polarity")])
    both = side("a").join(side("b"), ["query_id", "claim_type", "grp"]).filter((F.col("a_position") < F.col("b_position")) & (F.col("a_doc_id") != F.col("b_doc_id")))
    get = lambda p: {f: F.col(f"{p}_{f}") for f in ("metric_terms", "setting_terms", "subject_terms", "method_family")} | {"claim_type": F.col("claim_type")}
    scored = both.withColumn("score", align_score(get("a"), get("b"))).filter(F.col("score") >= C.ALIGN_THRESHOLD)
    opposite = (F.least("a_polarity", "b_polarity") == "negative") & (F.greatest("a_polarity", "b_polarity") == "positive")
    metric, setting = overlap(F.col("a_metric_terms"), F.col("b_metric_terms")) > 0, overlap(F.col("a_setting_terms"), F.col("b_setting_terms")) > 0
    no_setting = (F.size("a_setting_terms") == 0) & (F.size("b_setting_terms") == 0)
    with_metric = (F.size("a_metric_terms") > 0) & (F.size("b_metric_terms") > 0)
    comparable = F.col("claim_type").isin("method", "limitation", "problem", "claim") | metric | setting | ((F.col("claim_type") == "result") & ~with_metric & no_setting)
    kind = F.when(~comparable, "incomparable").when(opposite, "contradicts").when(F.col("claim_type") == "result", F.when(metric, "same_metric").when(setting, "same_dataset").otherwise("supports")).when(F.col("claim_type") == "limitation", "limitation_of").otherwise("supports")
    made = scored.withColumn("relation", kind).withColumn("g", F.concat_ws("|", F.col("query_id").cast("string"), "claim_type", F.col("grp").cast("string")))
    best = ranked(made, per_group, F.round("score", 9).desc(), F.col("a_frame_id"), F.col("b_frame_id"), partition="g")
    return best.select("query_id", "claim_type", "grp", F.col("a_frame_id").alias("source_frame_id"), F.col("b_frame_id").alias("target_frame_id"), "relation", "score")


def answer_buckets(claims: DataFrame, per_bucket: int = 8) -> DataFrame:
    """Claims of each query by bucket: (query_id, bucket, rank, frame_id, score)."""
    s, r = F.col("semantic_support_status"), F.col("citation_risk")
    bucket = (
        F.when((s == "semantically_supported") & (r == "safe"), "strong_claims")
        .when((s == "partially_supported") & (r == "needs_qualification"), "qualified_claims")
        .when((s == "contradicted") | (r == "conflicting_evidence"), "conflicting_claims")
        .when(s == "insufficient_evidence", "insufficient_claims")
        .when(s == "related_only", "related_claims")
        .otherwise("unchecked_claims")
    )
    once = claims.withColumn("bucket", bucket).groupBy("query_id", "bucket", "doc_id", "frame_id", "short_claim").agg(F.max("score").alias("score"))
    keyed = once.withColumn("k", F.concat_ws("|", F.col("query_id").cast("string"), "bucket"))
    return ranked(keyed, per_bucket, F.col("score").desc(), F.col("frame_id"), F.col("short_claim"), partition="k").select("query_id", "bucket", "rank", "frame_id", "score")


def answerability(buckets: DataFrame) -> DataFrame:
    """(query_id, answerability, warnings) of the buckets of each query."""
    n = {b: F.count_if(F.col("bucket") == f"{b}_claims") for b in ("strong", "qualified", "conflicting", "insufficient", "unchecked")}
    per = buckets.groupBy("query_id").agg(*[c.alias(b) for b, c in n.items()])
    what = F.when(F.col("conflicting") > 0, "conflicting").when(F.col("strong") > 0, "answerable").when(F.col("qualified") > 0, "partially_answerable").otherwise("insufficient_evidence")
    warnings = F.array_join(F.array_compact(F.array(F.when(F.col("conflicting") > 0, "answer_plan_conflicting_claims"), F.when((F.col("insufficient") > 0) & (F.col("strong") + F.col("qualified") == 0), "answer_plan_insufficient_evidence"), F.when(F.col("unchecked") > 0, "answer_plan_unchecked_claims"))), ",")
    return per.select("query_id", what.alias("answerability"), warnings.alias("warnings"))
