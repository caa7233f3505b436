"""The operators' queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.bpe import encode
from rankloom.llm.chat import format_turns, read_examples, render_examples, turns_of
from rankloom.llm.collocations import collocations
from rankloom.llm.common import LOWER, UPPER, WHITE
from rankloom.llm.curves import nearest_neighbours
from rankloom.llm.decontam import find_contamination
from rankloom.llm.langid import identify, learn
from rankloom.llm.line_dedup import apply_bitmaps, keep_bitmaps
from rankloom.llm.lm import score_texts
from rankloom.llm.neardup import near_duplicates
from rankloom.llm.runs import periodic_runs
from rankloom.llm.sharding import interleave
from rankloom.llm.topk import top_k
from rankloom.llm.warc import archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: White space of words and line keys, for SQL.
SQL_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


#: A common table expression, ``crc (t)``: the table of CRC-32.
SQL_CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                 lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"""


def sql_crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes; ``crc`` must be among the tables."""
    value = "((instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)::BIGINT"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: {value})"
    reduced = f"list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c // 256, crc.t[xor(c % 256, b) + 1]))"
    return f"xor({reduced}, 4294967295::BIGINT)"


def sql_put(table: str, groups: str) -> str:
    """A recursive step: the next of ``groups`` (k, grp, m) goes to the first shard of those with most room, if that is enough (else -1)."""
    top, spot = "list_max(p.room)", "list_position(p.room, list_max(p.room))"
    room = f"CASE WHEN {top} >= g.m THEN list_transform(p.room, lambda r, i: CASE WHEN i = {spot} THEN r - g.m ELSE r END) ELSE p.room END"
    return f"SELECT p.k + 1, {room}, g.grp, CASE WHEN {top} >= g.m THEN {spot} - 1 ELSE -1 END FROM {table} p JOIN {groups} g ON g.k = p.k + 1"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def docs_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(
    "op2_line_dedup",
    f"""
    WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
         keys AS (SELECT doc_id, pos, line, translate(trim(line, {SQL_WHITE}), '{UPPER}', '{LOWER}') AS key FROM lines),
         common AS (SELECT key FROM keys WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
         marked AS (SELECT doc_id, pos, line, key IN (SELECT key FROM common) AS dropped FROM keys)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_docs=10, keep_first=False))
    kept = F.sha2(F.coalesce("__kept_text", F.lit("")), 256)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


PLANTED = "\\### Assistant: </turn> ok"


@register(
    "op5_chat_prefix_targets",
    f"""
    WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
         sized AS (SELECT *, 15 + length(replace(replace(replace(role, '\\', '\\b'), '</turn>', '\\e'), '###', '\\h'))
                             + length(replace(replace(replace(text, '\\', '\\b'), '</turn>', '\\e'), '###', '\\h')) AS chars FROM turns)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           sum(chars)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = docs_of(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PLANTED).alias("text"))
    read = read_examples(render_examples(format_turns(turns.unionByName(planted)), rest=True))
    # A digest needs its text in one piece, so here, unlike in the operator, what was read of a conversation meets in one row.
    loss = F.when(F.col("loss_start").isNotNull(), F.struct("loss_start", "loss_text"))
    whole = read.groupBy("conv_id").agg(F.max("whole").alias("whole"), F.sort_array(F.collect_list(loss)).alias("losses"), F.coalesce(F.sum(F.char_length("loss_text")), F.lit(0)).cast("long").alias("loss_chars"))
    both = F.transform(turns_of(F.col("whole")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    digest = lambda texts: F.sha2(F.array_join(texts, ""), 256)
    whole = whole.select("conv_id", both.alias("turns"), "losses", "loss_chars", F.char_length("whole").cast("long").alias("formatted_chars"))
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest("turns").alias("turns_sha256"), "loss_chars", digest("losses.loss_text").alias("loss_sha256"), "formatted_chars")


@register(
    "op10_interleaved_shards",
    f"""
    WITH RECURSIVE {SQL_CRC}, docs AS (SELECT doc_id, source, text, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
                         CASE WHEN text IS NULL THEN 0 ELSE {sql_crc32("coalesce(text, '')")} END AS text_crc32,
                         coalesce(md5(text), 'null') AS grp, md5('2024:' || coalesce(doc_id::VARCHAR, 'null')) AS mix FROM documents, crc),
         ranked AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY mix, doc_id, grp) - 1 + 0.5::DOUBLE)
                              / (count(*) OVER (PARTITION BY source))::DOUBLE AS fraction, count(*) OVER () AS n FROM docs),
         placed AS (SELECT *, row_number() OVER (ORDER BY fraction, mix, doc_id, grp) - 1 AS pos FROM ranked),
         groups AS (SELECT grp, count(*) AS m, min(pos) AS first, any_value(n) AS n FROM placed GROUP BY grp HAVING count(*) > 1),
         big AS (SELECT grp, m, row_number() OVER (ORDER BY m DESC, first) AS k FROM groups WHERE m * 16 > n // 16 AND m <= (n + 15) // 16),
         big_put AS (SELECT 0::BIGINT AS k, (SELECT list((s + 1) * n // 16 - s * n // 16 ORDER BY s) FROM range(16) t(s), (SELECT count(*) AS n FROM docs)) AS room,
                            NULL::VARCHAR AS grp, -1::BIGINT AS shard
                     UNION ALL {sql_put("big_put", "big")}),
         rooms AS (SELECT s, room[s + 1] AS r, sum(room[s + 1]) OVER (ORDER BY s) AS e, sum(room[s + 1]) OVER () AS total
                   FROM range(16) t(s), (SELECT room FROM big_put ORDER BY k DESC LIMIT 1)),
         laid AS (SELECT grp, m, first, coalesce(sum(m) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto, sum(m) OVER () AS total
                  FROM groups WHERE m * 16 <= n // 16),
         small AS (SELECT grp, m, first, (SELECT count(*) FROM rooms WHERE floor(upto::DOUBLE / laid.total::DOUBLE * rooms.total::DOUBLE) >= e) AS shard FROM laid),
         tried AS (SELECT grp, m, first, shard, sum(m) OVER (PARTITION BY shard ORDER BY first) <= r AS fits FROM small JOIN rooms ON s = shard),
         late AS (SELECT grp, m, row_number() OVER (ORDER BY m DESC, first) AS k FROM tried WHERE NOT fits),
         late_put AS (SELECT 0::BIGINT AS k, (SELECT list(r - coalesce((SELECT sum(m) FROM tried WHERE shard = s AND fits), 0)::BIGINT ORDER BY s) FROM rooms) AS room,
                             NULL::VARCHAR AS grp, -1::BIGINT AS shard
                      UNION ALL {sql_put("late_put", "late")}),
         whole AS (SELECT grp, shard FROM big_put WHERE shard >= 0 UNION ALL SELECT grp, shard FROM late_put WHERE shard >= 0
                   UNION ALL SELECT grp, shard FROM tried WHERE fits),
         ends AS (SELECT s, sum(room[s + 1]) OVER (ORDER BY s) AS e FROM range(16) t(s), (SELECT room FROM late_put ORDER BY k DESC LIMIT 1)),
         single AS (SELECT p.*, row_number() OVER (ORDER BY pos) - 1 AS q FROM placed p WHERE grp NOT IN (SELECT grp FROM whole)),
         dealt AS (SELECT doc_id, source, size, text_crc32, pos, (SELECT count(*) FROM ends WHERE q >= e) AS shard FROM single
                   UNION ALL SELECT doc_id, source, size, text_crc32, pos, w.shard FROM placed p JOIN whole w USING (grp))
    SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, NULL::INT AS grown_shard, source
    FROM dealt""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(docs_of(spark, sf_dir), n_shards=16)


@register("op9_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(docs_of(spark, sf_dir), k=5, percent=85)


def item_digest(items: str) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)


@register(
    "op8_decontamination",
    f"""
    WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
         items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
         windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS win
                     FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
         lengths AS (SELECT DISTINCT n FROM windows),
         spots AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win FROM words, lengths, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
         found AS (SELECT doc_id, item_id, i, s.n FROM spots s JOIN windows USING (win)),
         hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
         listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "benchmark"), window=13, percent=5)
    return found.select("doc_id", "n_words", "n_hit", "n_items", item_digest("items").alias("items_sha256"), "contaminated")


def fold(modulus: int) -> Column:
    """crc32 of the document id as text, modulo ``modulus``; a null id is the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(modulus))


@register("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    samples = learn(docs.where(fold(4) != 2))
    rows = docs.select("doc_id", (fold(4) == 2).alias("held_out"), "text")
    return identify(rows, samples)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op4_bpe_chunk_reuse")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(docs_of(spark, sf_dir).select("doc_id", "text"), word_tokenizer(), digests=True)


@register(
    "op3_arc_to_warc",
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
         r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
    FROM r""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(docs_of(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register(
    "op1_maxscore_topk",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
               FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = docs_of(spark, sf_dir, "embeddings").where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    items = vectors.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("vector"))
    return top_k(items.where("id % 100 = 0"), items, k=10)


@register("op6_deleted_interpolation")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, model = score_texts(docs_of(spark, sf_dir), fold(7) != 2)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["train_tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


@register("op11_hilbert_neighbours")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = docs_of(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest_neighbours(items.where("id % 100 = 0"), items, k=10)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text; every tenth document's words, by its hash, repeat from one of them on."""
    h, bare = F.crc32(F.col("doc_id").cast("string")), F.btrim("text", F.lit(WHITE))
    split = F.when((h % 10 == 0) & (bare != ""), F.split(bare, f"[{WHITE}]+")).alias("words")
    rows = docs.select("doc_id", "text", split, F.floor(h / 10).alias("g")).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.expr("IF(words IS NULL, 0, g % n)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("slice(concat(slice(words, 1, int(a)), flatten(array_repeat(slice(words, int(a) + 1, int(p)), int((n - a - 1) div p) + 1))), 1, int(n))")
    return rows.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(planted, " ")).alias("text"))


@register("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(docs_of(spark, sf_dir)), keep=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.withColumn("top", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("top.length * 1000 div -top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@register(
    "op13_collocation_stripes",
    f"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
         words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
         one AS (SELECT lang, a, count(*) AS n FROM (SELECT lang, unnest(w) AS a FROM words) GROUP BY ALL),
         two AS (SELECT lang, w[i] AS a, w[i + 1] AS b, count(*) AS f FROM words, unnest(range(1, len(w))) t(i) GROUP BY ALL HAVING count(*) >= 10),
         three AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, count(*) AS f FROM words, unnest(range(1, len(w) - 1)) t(i) GROUP BY ALL HAVING count(*) >= 10),
         holds AS (SELECT lang, a, b, max(f) AS m FROM (SELECT lang, a, b, f FROM three UNION ALL SELECT lang, b, c, f FROM three) GROUP BY ALL),
         cuts AS (SELECT two.lang, concat_ws(' ', two.a, two.b) AS phrase, f, x.n AS l, y.n AS r, 1 AS k FROM two JOIN one x ON x.lang = two.lang AND x.a = two.a
                         JOIN one y ON y.lang = two.lang AND y.a = two.b LEFT JOIN holds h ON h.lang = two.lang AND h.a = two.a AND h.b = two.b WHERE coalesce(100 * m < 50 * f, true)
                  UNION ALL SELECT t.lang, concat_ws(' ', t.a, t.b, t.c), t.f, x.n, y.f, 1 FROM three t JOIN one x ON x.lang = t.lang AND x.a = t.a JOIN two y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c
                  UNION ALL SELECT t.lang, concat_ws(' ', t.a, t.b, t.c), t.f, x.f, y.n, 2 FROM three t JOIN two x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b JOIN one y ON y.lang = t.lang AND y.a = t.c),
         scored AS (SELECT *, (1000000::HUGEINT * f::HUGEINT * f::HUGEINT // (l::HUGEINT * r::HUGEINT))::BIGINT AS score FROM cuts),
         least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM least)
    SELECT lang, rank, phrase, f AS a, l, r, s.n::BIGINT AS n, score FROM ranked JOIN (SELECT lang, sum(n) AS n FROM one GROUP BY lang) s USING (lang) WHERE rank <= 2000""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(docs_of(spark, sf_dir))
