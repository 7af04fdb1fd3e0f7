"""The opN_ queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelframe.llm import bpe, cascade, chat, html, linededup, media, merkle, mixing, ngram_lm, packing, rule_ensemble, search, simhash
from panelframe.llm.shared import bounded_batches
from panelframe.llm.stats import counts_of

VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trie = ngram_lm.train(docs.where(~ngram_lm.held_out("doc_id")))
    scored = docs.select("doc_id", ngram_lm.held_out("doc_id").alias("held_out"), ngram_lm.score(trie, "text").alias("s"))
    return scored.select("doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "s.base_score", "s.score")


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op4_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), media.store("text").alias("media"), F.lit("text/plain").alias("declared"))
    typed = media.correct_types(stored.withColumn("back", media.reread("media")), "media", "declared", found="found", out="media_type")
    # the text with its stored form attached, as a message that carries media: the form is found in it and carved out
    mail = F.concat(F.encode("text", "UTF-8"), F.encode(F.lit("\n"), "UTF-8"), F.col("media"), F.encode(F.lit("\n"), "UTF-8"))
    mailed = typed.withColumn("mail", mail).withColumn("pieces", media.pieces(F.col("mail"), media.sniff("mail")))
    payload, at = F.col("back.payload"), F.get(F.filter("pieces", lambda p: p["offset"] == F.col("n_bytes") + 1), 0)
    return mailed.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -media.UNIT, media.UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("back.feature").alias("feature"),
        "declared",
        "media_type",
        "media_type_wrong",
        F.size("pieces").alias("n_carved"),
        at["kind"].alias("carved_type"),
        F.sha2(at["bytes"], 256).alias("carved_sha256"),
    )


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = rule_ensemble.with_statistics(_table(spark, sf_dir, "documents"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = rule_ensemble.fit(stats.where(~rule_ensemble.held_out()).join(labels, "doc_id"))
    scored = stats.select("doc_id", rule_ensemble.held_out().alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("counts", counts_of("text"))
    judged = cascade.verdict(docs, cascade.ordered(cascade.estimate(docs, counts="counts")))  # every row gets its counts: no rule pays for them
    c = F.col("counts")
    failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
    return judged.select(
        "doc_id",
        *(c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"),
        (~failed & F.col("rejected_by").isNull()).alias("kept"),
    )


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    coded = bpe.encode(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, stable=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_sha256("ids").alias("ids_sha256"),
        F.sha2(bpe.decode(spark, "ids", vocabulary), 256).alias("decoded_sha256"),
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.decide(_table(spark, sf_dir, "documents"))
    each = made.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def op9_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html.extract(pages, report="went")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "went.by_count", "went.by_role", "went.by_comment", "went.by_article")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.with_removed(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines"), F.size("removed").alias("n_removed"), "removed")


def op11_pair_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build(_table(spark, sf_dir, "documents"))
    return search.search(index, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = packing.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(_table(spark, sf_dir, "documents"), tokenizer)
    return packed.select("doc_id", "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in fields]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf(more))
    out = merkle.prove(_table(spark, sf_dir, "documents"), "lang", "doc_id", fields, tampered)
    proof = F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_elias_fano_lm,
        op3_chat_perspectives,
        op4_media_sniffing,
        op5_rule_ensemble,
        op6_quality_cascade,
        op7_bpe_round_trip,
        op8_source_mixing,
        op9_template_removal,
        op10_line_dedup,
        op11_pair_bound_search,
        op12_best_fit_packing,
        op13_merkle_manifest,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
# a row's leaf, with an expression for n_chars; and the CRC-32 of doc_id's decimals, bit by bit
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST({0} AS VARCHAR)", "text")) + ")"
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
ORACLE_SQL: dict[str, str] = {
    "op3_chat_perspectives": """
        WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
        who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
        r AS (SELECT m.conv_id, perspective, turn, speaker, text,
                CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10) WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
                     ELSE '<|user:' || speaker || '|>' || chr(10) END AS head
              FROM m JOIN who ON m.conv_id IS NOT DISTINCT FROM who.conv_id),
        s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM r),
        o AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg_end FROM s)
        SELECT conv_id, perspective, turn, speaker, segment, CAST(seg_end - length(segment) AS BIGINT) AS seg_start, CAST(seg_end AS BIGINT) AS seg_end,
               CAST(CASE WHEN speaker = perspective THEN seg_end - length(segment) + length(head) ELSE seg_end END AS BIGINT) AS mask_start,
               CAST(seg_end AS BIGINT) AS mask_end FROM o""",
    "op6_quality_cascade": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        g AS (SELECT doc_id, rid, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS gram
              FROM (SELECT doc_id, rid, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT *, row_number() OVER () AS rid FROM d) WHERE len(w) >= 5)),
        twice AS (SELECT doc_id, rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
        l AS (SELECT doc_id, line, n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, 1 AS n FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        ld AS (SELECT doc_id, sum(c) AS lines, sum(c - 1) AS dups FROM (SELECT doc_id, line, count(*) AS c FROM l GROUP BY ALL) GROUP BY doc_id),
        c AS (SELECT d.doc_id, text, CAST(len(w) AS BIGINT) AS n_words,
                CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines, 0) AS n_lines,
                len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_adjacent,
                length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS upper, length(text) - length(regexp_replace(text, '\p{{Ll}}', '', 'g')) AS lower
              FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN ld ON d.doc_id = ld.doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 50 * n_symbols > length(text) OR upper > lower OR 10 * n_adjacent > 3 * n_words
                    OR 2 * n_dup_lines > n_lines OR NOT regexp_matches(text, '\p{{L}}')) AS kept FROM c""",
    "op11_pair_bound_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
        i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark),
        c AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
        s AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM c, s GROUP BY term, docs),
        a AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
        f AS (SELECT q, item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
              FROM a JOIN w USING (term) JOIN c USING (term), s GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM f WHERE score > 0 QUALIFY rank <= 20""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS k, {_LEAF.format("n_chars")} AS leaf,
            CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.format("n_chars + 1")} ELSE {_LEAF.format("n_chars")} END AS used FROM documents),
        l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM d),
        t AS (SELECT k, 0 AS level, pos, leaf AS h, n FROM l UNION ALL SELECT k, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY k, level, pos // 2, n),
        g AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos, h AS subroot, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (SELECT 0 AS level, pos, subroot AS h, n FROM g UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
        f AS (SELECT r, k, 0 AS level, pos, used AS h, '' AS said, n FROM l UNION ALL
              SELECT f.r, f.k, f.level + 1, f.pos // 2, CASE WHEN t.h IS NULL THEN sha256(f.h) WHEN f.pos % 2 = 1 THEN sha256(t.h || f.h) ELSE sha256(f.h || t.h) END, f.said || coalesce(t.h, ''), (f.n + 1) // 2
              FROM f LEFT JOIN t ON t.k = f.k AND t.level = f.level AND t.pos = f.pos + 1 - 2 * (f.pos % 2) WHERE f.n > 1),
        e AS (SELECT f.r, 0 AS level, g.pos, f.h, f.said, g.n FROM f JOIN g ON g.k = f.k WHERE f.n = 1 UNION ALL
              SELECT e.r, e.level + 1, e.pos // 2, CASE WHEN u.h IS NULL THEN sha256(e.h) WHEN e.pos % 2 = 1 THEN sha256(u.h || e.h) ELSE sha256(e.h || u.h) END, e.said || coalesce(u.h, ''), (e.n + 1) // 2
              FROM e LEFT JOIN u ON u.level = e.level AND u.pos = e.pos + 1 - 2 * (e.pos % 2) WHERE e.n > 1)
        SELECT doc_id, leaf, subroot, root, sha256(e.said) AS proof_sha256, e.h AS folded_root, e.h = root AS verified
        FROM e JOIN l ON l.r = e.r JOIN g ON g.k = l.k CROSS JOIN (SELECT h AS root FROM u WHERE n = 1) WHERE e.n = 1""",
}
