"""Traces, reasons, gaps, alternatives, cited cards and their grounding, all as columns."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.contexts import MAX_TOP_N
from rankloom.functions.scalar import clip01, rounded
from rankloom.operators.scoring import weights_payload
from rankloom.session import materialised

# Datasets and units of a trace, cards a type and the claims they make.
TRACE_RNA = [("DepMap_RNAseq", "depmapRnaRaw", "log2(TPM+1)"), ("HPA_RNAseq", "hpaRnaRaw", "log2(nTPM+1)"), ("GEO_RNA", "geoRnaRaw", "log2(intensity+1)")]
CARDS_OF_TYPE = {"RANKING": 1, "SCORE": 1, "MEASUREMENT": 3, "GAP": 10, "ALTERNATIVE": 3, "SUPPLEMENTARY": 1}
CLAIM_OF_TYPE = {"GAP": "LIMITATION", "ALTERNATIVE": "ALTERNATIVE", "SUPPLEMENTARY": "CONTEXT"}
NUMBER = r"(?<![A-Za-z])[-+]?\d+(?:\.\d+)?"
FINGERPRINTED = ["rank", "DepMap_ID", "cellLine", "finalScore", "confidenceScore", "recommendationLevel"]


def trace(mode: str) -> Column:
    """The evidence of a row, in order: array of (dataset, type, value, unit)."""
    only = mode == "PROTEIN_ONLY"
    role = "SUPPORTING" if only else "PRIMARY"

    def item(dataset: str, kind: Column, value: str, unit: str, there: Column) -> Column:
        entry = F.struct(F.lit(dataset).alias("dataset"), kind.alias("type"), F.col(value).alias("value"), F.lit(unit).alias("unit"))
        return F.when(there, entry)

    own = "PRIMARY_target_protein_expression" if only else "PRIMARY_protein_expression"
    protein = item("CCLE_Gygi_Proteomics", F.lit(own), "proteinRaw", "log2 MS intensity", F.col("proteinRaw").isNotNull())
    rna = [item(d, F.lit(f"{role}_rna_expression"), v, u, F.col(v).isNotNull()) for d, v, u in TRACE_RNA]
    mutation = F.when(F.col("hasHighImpactMutation"), f"{role}_high_impact_mutation").otherwise(f"{role}_mutation")
    events = [
        item("DepMap_Mutation", mutation, "mutationRaw", "event count", F.col("hasMutation")),
        item("DepMap_Fusion", F.lit(f"{role}_fusion"), "fusionRaw", "event count", F.col("hasFusion")),
        item("DepMap_Fusion", F.lit(f"{role}_fusion_confidence"), "fusionConfidenceRaw", "source confidence", F.col("hasFusion") & F.col("fusionConfidenceRaw").isNotNull()),
    ]
    return F.array_compact(F.array(*([protein, *rna] if only else [*rna, protein]), *events))


def merged_trace() -> Column:
    """The evidence of a row of the merged ranker, in order: array of (dataset, type, value, unit); types name no role."""
    there = {"proteinRaw": ("CCLE_Gygi_Proteomics", "protein_expression", "log2 MS intensity")} | {v: (d, "rna_expression", u) for d, v, u in TRACE_RNA}
    measured = [(*there[v], v, F.col(v).isNotNull()) for v in (*(v for _, v, _ in TRACE_RNA), "proteinRaw")]
    fused = F.col("hasFusion")
    events = [
        ("DepMap_Mutation", F.when(F.col("hasHighImpactMutation"), "high_impact_mutation").otherwise("mutation"), "event count", "mutationRaw", F.col("hasMutation")),
        ("DepMap_Fusion", "fusion", "event evidence", "fusionRaw", fused),
        ("DepMap_Fusion", "fusion_confidence", "source confidence", "fusionConfidenceRaw", fused & F.col("fusionConfidenceRaw").isNotNull()),
    ]
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    items = (F.when(when, F.struct(F.lit(d).alias("dataset"), column(kind).alias("type"), F.col(v).alias("value"), F.lit(unit).alias("unit"))) for d, kind, unit, v, when in (*measured, *events))
    return F.array_compact(F.array(*items))


def graded(score: Column, what: str, symbol: str) -> Column:
    return F.when(score >= 0.70, f"Strong {what} for {symbol}.").when(score >= 0.40, f"Moderate {what} for {symbol}.").otherwise(f"Limited {what} for {symbol}.")


def reasons(mode: str, gene: str | None, protein: str | None, exclusion: str | None, context: str | None) -> Column:
    """Sentences on a scored row; no context: it was ranked over all contexts."""
    first = f"The cell line passed the disease-specific hard filter for {context}." if context else "The cell line was ranked across all diseases and tissues."
    out = [F.lit(first)]
    if mode == "PROTEIN_ONLY":
        out.append(graded(F.col("proteinScore"), "protein expression evidence", protein))
        out.append(F.when(F.col("rnaScore").isNotNull(), "RNA evidence is available as supporting context but is not used directly in the protein-only biological score."))
    else:
        out.append(graded(F.col("rnaScore"), "RNA expression evidence", gene))
        there = f"Supporting protein-level evidence is available for {protein or gene}."
        out.append(F.when(F.col("proteinScore").isNotNull(), there).otherwise("Protein evidence is missing; its weight was redistributed and confidence was reduced."))
    altered = F.concat(F.lit(f"Genomic alteration detected for {gene or protein}: "), F.col("alterationStatus"), F.lit("."))
    out.append(F.when(F.col("alterationStatus") != "NO ALTERATION", altered))
    if exclusion:
        minor = f"The exclusion gene {exclusion} does not cause a major penalty."
        major = f"A penalty is applied because {exclusion} shows relatively high RNA expression evidence."
        out.append(F.when(F.col("exclusionPenalty") <= 0.05, minor).otherwise(major))
    return F.array_compact(F.array(*out))


def gaps(mode: str, target: str) -> Column:
    role = "supporting " if mode == "PROTEIN_ONLY" else ""
    missing = [("hasDepMapRNA", f"Missing {role}DepMap RNA-seq evidence."), ("hasHpaRNA", f"Missing {role}HPA RNA-seq evidence."), ("hasGeoRNA", f"Missing {role}GEO RNA-expression evidence."), ("hasProteomics", f"Missing CCLE-Gygi proteomics evidence for {target}.")]
    return F.array_compact(F.array(*(F.when(~F.col(flag), text) for flag, text in missing)))


def card_gaps(mode: str, target: str) -> Column:
    top = "is not measured for the top recommendation."
    missing = [("hasDepMapRNA", f"DepMap RNA-seq evidence {top}"), ("hasHpaRNA", f"HPA RNA-seq evidence {top}"), ("hasGeoRNA", f"GEO RNA expression evidence {top}"), ("hasProteomics", f"CCLE-Gygi protein evidence for {target} {top}")]
    out = [F.when(~F.col(flag), text) for flag, text in missing]
    if mode == "PROTEIN_ONLY":
        out.append(F.when(~F.col("hasProteomics"), "The protein-only query cannot substitute RNA for missing protein evidence."))
    return F.array_compact(F.array(*out))


def alternatives(scored: DataFrame, k: int = 5, shown: tuple[str, ...] = (), tie: str = "DepMap_ID") -> DataFrame:
    """The rows most like the top row: 1 - mean difference of the scores that both have; other columns as ``shown``, ties by ``tie``."""
    top = scored.where("rank = 1").select(F.col("rnaScore").alias("r"), F.col("proteinScore").alias("p"))
    rows = scored.where("rank > 1").crossJoin(F.broadcast(top))
    apart = F.array_compact(F.array(F.abs(F.col("r") - F.col("rnaScore")), F.abs(F.col("p") - F.col("proteinScore"))))
    total = F.aggregate(apart, F.lit(0.0), lambda a, x: a + x)
    alike = F.coalesce(clip01(1.0 - F.try_divide(total, F.size(apart))), F.lit(0.0))
    out = rows.select("DepMap_ID", F.col("cellLine").alias("alternativeCellLine"), rounded(alike).alias("similarityScore"), "finalScore", "targetGeneLabel", *shown, F.col(tie).alias("__tie"))
    return out.orderBy(F.desc("similarityScore"), F.desc("finalScore"), "__tie").limit(k).drop("__tie")


def merged_alternatives(scored: DataFrame, k: int = 5) -> DataFrame:
    """``alternatives`` of the merged ranker: with lineage and disease, ties in the order of the ranks."""
    return alternatives(scored, k, ("lineage", "disease"), "rank")


def top_features(profile: DataFrame, by: str, feature: str, value: str, n: int = 5) -> DataFrame:
    """Per entity an array of its n largest features (feature, value); replicates averaged, ties by name."""
    means = profile.groupBy(by, feature).agg(F.avg(value).alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("value"), feature))
    kept = means.withColumn("n", nth).where(F.col("n") <= n)
    ranked = kept.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("n", F.col(feature).alias("feature"), "value"))).alias("top"))
    return ranked.select(by, F.transform("top", lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"))).alias("top"))


def fingerprint(ranked: DataFrame) -> DataFrame:
    """One row: SHA-256 over the fields that an explanation may not change, in rank order, and the number of rows.

    Each row is hashed, then the rows of each thousand ranks, then those, so no task holds all rows.
    """
    text = [F.format_string("%.4f", F.col(c)) if c.endswith("Score") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FINGERPRINTED]
    lines = ranked.select("rank", F.expr("rank div 1000").alias("part"), F.sha2(F.concat_ws("|", *text), 256).alias("h"))
    whole = lambda key: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), ""), 256)
    parts = lines.groupBy("part").agg(whole("rank").alias("h"), F.count(F.lit(1)).alias("n"))
    return parts.agg(whole("part").alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def frozen(ranked: DataFrame) -> DataFrame:
    """The rows of a request's short list, ranked once; a longer list is refused."""
    rows = ranked.orderBy("rank").limit(MAX_TOP_N + 1).collect()
    if len(rows) > MAX_TOP_N:
        raise ValueError(f"a short list of {MAX_TOP_N} rows at most is expected")
    return ranked.sparkSession.createDataFrame(rows, ranked.schema)


def four(c: str) -> Column:
    return F.format_string("%.4f", F.col(c))


def evidence_id(kind: str, *parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 12)


def cards(ranked: DataFrame, mode: str, gene: str | None, protein: str | None, context: DataFrame | None = None) -> DataFrame:
    """Cards of a short ranked list: position, evidence_id, card_type, text, source, DepMap_ID, cellLine, target, values.

    With a ``context`` (see ``entity_context``) the best entity's global signatures, if it has any, are a SUPPLEMENTARY card.

    The list is what a request returns, MAX_TOP_N rows at most, and is brought to the driver once, so that the
    cards' plan doesn't rank again for every kind of card.
    """
    ranked = frozen(ranked)
    target = f"gene {gene} and protein {protein}" if gene and protein else f"gene {gene}" if gene else f"protein {protein}"
    top = ranked.where("rank = 1")

    def made(rows: DataFrame, kind: str, text: Column, source: Column, values: Column, position: Column, *key: Column) -> DataFrame:
        return rows.select(position.alias("position"), evidence_id(kind, *key).alias("evidence_id"), F.lit(kind).alias("card_type"), text.alias("text"), source.alias("source"), "DepMap_ID", "cellLine", F.lit(target).alias("target"), values.alias("values"))

    rank_text = F.concat(
        F.lit("The deterministic recommender ranks "), "cellLine", F.lit(" ("), "DepMap_ID", F.lit(") at position "), F.col("rank").cast("string"), F.lit(f" for {target}, with final score "),
        four("finalScore"), F.lit(", confidence score "), four("confidenceScore"), F.lit(", and recommendation level "), "recommendationLevel", F.lit("."),
    )
    numbers = F.array(F.col("rank").cast("double"), "finalScore", "confidenceScore")
    ranking = made(ranked, "RANKING", rank_text, F.lit("dynamic_multiomics_recommender"), numbers, F.col("rank"), F.col("DepMap_ID"), F.col("rank"), F.col("finalScore"))

    named = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name} "), four(c)))
    parts = F.concat_ws(", ", F.coalesce(named("RNA score", "rnaScore"), F.lit("RNA score not measured")), F.coalesce(named("protein score", "proteinScore"), F.lit("protein score not measured")), named("biological score", "biologicalScore"), named("exclusion penalty", "exclusionPenalty"), named("data completeness", "completenessScore"), named("source support", "sourceSupportScore"))
    text = F.concat(F.lit("For "), "cellLine", F.lit(", the deterministic score breakdown is: "), parts, F.lit("."))
    values = F.array_compact(F.array("rnaScore", "proteinScore", "biologicalScore", "exclusionPenalty", "completenessScore", "sourceSupportScore"))
    score = made(top, "SCORE", text, F.lit("score_candidates"), values, F.lit(1000), F.col("DepMap_ID"), parts)

    none = F.array().cast("array<double>")
    gap_rows = top.select("DepMap_ID", "cellLine", F.posexplode(card_gaps(mode, protein or gene)).alias("n", "gap"))
    gap = made(gap_rows, "GAP", F.col("gap"), F.lit("data_availability"), none, F.lit(2000) + F.col("n"), F.col("gap"))

    seen = top.select("DepMap_ID", "cellLine", F.posexplode(trace(mode)).alias("n", "t"))
    said = F.concat(F.col("t.dataset"), F.lit(" reports "), F.col("t.type"), F.lit(" for "), "cellLine", F.lit(" with value "), F.format_string("%.4f", F.col("t.value")), F.lit(" "), F.col("t.unit"), F.lit("."))
    measured = made(seen, "MEASUREMENT", said, F.col("t.dataset"), F.array_compact(F.array(F.col("t.value"))), F.lit(3000) + F.col("n"), F.col("DepMap_ID"), F.col("t.dataset"), F.col("t.type"))

    other = alternatives(ranked).withColumnRenamed("alternativeCellLine", "cellLine")
    like = F.concat("cellLine", F.lit(" is a similar alternative to the top recommendation, with similarity score "), four("similarityScore"), F.lit("."))
    nth = F.row_number().over(Window.orderBy(F.desc("similarityScore"), F.desc("finalScore"), "DepMap_ID"))
    similar = made(other.withColumn("nth", nth), "ALTERNATIVE", like, F.lit("deterministic_similarity"), F.array("similarityScore"), F.lit(4000) + F.col("nth"), F.col("DepMap_ID"), F.col("similarityScore"))
    out = ranking
    for more in (score, gap, measured, similar):
        out = out.unionByName(more)
    if context is not None:
        signed = top.join(context.select("DepMap_ID", "global_signatures"), "DepMap_ID").where(F.size("global_signatures") > 0)
        about = F.concat(F.lit("Supplementary global signatures are available for "), "cellLine", F.lit("; they are context only and were not used in scoring."))
        out = out.unionByName(made(signed, "SUPPLEMENTARY", about, F.lit("File 14"), F.map_values("global_signatures"), F.lit(5000), F.col("DepMap_ID"), F.to_json("global_signatures")))
    return out


def scripted_claims(cards_df: DataFrame) -> DataFrame:
    """The first cards of each type as claims that cite themselves: position, text, claim_type, evidence_ids."""
    most, kind = F.lit(0), F.lit("SUPPORT")
    for t, n in CARDS_OF_TYPE.items():
        most = F.when(F.col("card_type") == t, n).otherwise(most)
    for t, claim in CLAIM_OF_TYPE.items():
        kind = F.when(F.col("card_type") == t, claim).otherwise(kind)
    nth = F.row_number().over(Window.partitionBy("card_type").orderBy("position"))
    kept = cards_df.withColumn("nth", nth).where(F.col("nth") <= most)
    return kept.select("position", "text", kind.alias("claim_type"), F.array("evidence_id").alias("evidence_ids"))


def masked(text: Column, names: Column) -> Column:
    """The text without the names (longest first, any case) and without ``log2(...)``; names are an array."""
    quoted = lambda x: F.concat(F.lit("(?i)"), F.regexp_replace(x, r"([^A-Za-z0-9 _])", r"\\$1"))
    ordered = F.array_sort(F.array_distinct(F.filter(names, lambda x: F.length(x) > 0)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    out = F.aggregate(ordered, text, lambda t, n: F.regexp_replace(t, quoted(n), F.lit(" ")))
    return F.regexp_replace(out, r"(?i)log2\([^)]*\)", " ")


def numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 0), lambda x: x.cast("double"))


def supported(number: Column, values: Column) -> Column:
    return F.exists(values, lambda v: F.abs(number - v) <= F.greatest(F.lit(1e-4), F.abs(v) * 1e-3))


def verify(claims: DataFrame, cards_df: DataFrame, mode: str = "l1l2") -> DataFrame:
    """Claims with ok and failed_layer: L1_citation, L2_numeric (numbers that no cited card carries) or, in mode
    ``full``, L3_entity (an entity that no cited card names)."""
    if mode not in ("none", "l1l2", "full"):
        raise ValueError("mode: none, l1l2 or full")
    if mode == "none":
        return claims.withColumns({"ok": F.lit(True), "failed_layer": F.lit(None).cast("string")})
    index = cards_df.select("evidence_id", F.array_compact(F.array("DepMap_ID", "cellLine", "target", "source")).alias("names"), F.array_compact(F.array("DepMap_ID", "cellLine", "target")).alias("entities"), "values").dropDuplicates(["evidence_id"])
    cited = claims.select("position", F.explode_outer("evidence_ids").alias("evidence_id")).join(index, "evidence_id", "left")
    flat = lambda c: F.flatten(F.collect_list(c))
    held = cited.groupBy("position").agg(F.count_if(F.col("names").isNull()).alias("unknown"), flat("names").alias("names"), flat("entities").alias("entities"), flat("values").alias("values"))
    rows = claims.join(held, "position", "left")
    loose = F.exists(numbers_in(masked(F.col("text"), F.col("names"))), lambda n: ~supported(n, F.col("values")))
    failed = F.when((F.size("evidence_ids") == 0) | (F.col("unknown") > 0), "L1_citation").when(loose, "L2_numeric")
    if mode == "full":
        known = cards_df.select(F.explode(F.array_compact(F.array("DepMap_ID", "cellLine"))).alias("e")).agg(F.collect_set(F.lower("e")).alias("known"))
        rows = rows.crossJoin(F.broadcast(known))
        own = F.transform("entities", lambda x: F.lower(x))
        failed = failed.when(F.exists("known", lambda e: F.contains(F.lower("text"), e) & ~F.array_contains(own, e)), "L3_entity")
    return rows.withColumn("failed_layer", failed).withColumn("ok", F.col("failed_layer").isNull()).select(*claims.columns, "ok", "failed_layer")


def normal_claims(claims: DataFrame) -> DataFrame:
    """Claims as writers give them, brought into form: text trimmed, type in upper case, cited ids an array without nulls."""
    ids = F.array_compact(F.coalesce(F.col("evidence_ids").cast("array<string>"), F.array().cast("array<string>")))
    return claims.withColumns({"text": F.trim(F.coalesce("text", F.lit(""))), "claim_type": F.upper(F.trim(F.coalesce("claim_type", F.lit("SUPPORT")))), "evidence_ids": ids})


def explain_run(ranked: DataFrame, mode: str, gene: str | None, protein: str | None, verifying: str = "full", context: DataFrame | None = None, reread: Callable[[], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The scripted writer over a short list: its checked claims, and one row of the fingerprint with whether the list is
    the same afterwards.

    Claims are made and stored first; then the list is read again, by ``reread`` where it is stored (else from its plan), and its fingerprint
    compared with the one taken before the writer ran.
    """
    before = materialised(fingerprint(ranked))
    made = cards(ranked, mode, gene, protein, context)
    claims = materialised(verify(normal_claims(scripted_claims(made)), made, verifying))
    after = fingerprint(reread() if reread else ranked).select(F.col("fingerprint").alias("after"))
    return claims, before.crossJoin(after).select("fingerprint", (F.col("fingerprint") == F.col("after")).alias("unchanged"), "n_rows")


def run_detail(run: DataFrame, rank: int, mode: str, target: str, context: DataFrame) -> DataFrame:
    """One rank of a saved run, for display: its row (candidate), weights (JSON), evidence_trace, data_gaps, the entity's
    supplementary context, and the fingerprint of the whole run. LookupError where the run has no such rank.

    The run must have all columns of a scored row. A short list is expected, as requests give one.
    """
    row = run.where(F.col("rank") == rank)
    if row.isEmpty():
        raise LookupError(f"rank {rank} is not among the results of this run")
    weights = F.lit(json.dumps(weights_payload(mode), ensure_ascii=False))
    shown = row.select("DepMap_ID", F.struct(*(F.col(c) for c in run.columns)).alias("candidate"), weights.alias("weights"), trace(mode).alias("evidence_trace"), gaps(mode, target).alias("data_gaps"))
    more = context.select("DepMap_ID", F.struct("global_signatures", "top_mirna", "top_metabolites", "notes").alias("supplementary"))
    return shown.join(more, "DepMap_ID", "left").crossJoin(fingerprint(run).select(F.col("fingerprint").alias("ranking_fingerprint")))
