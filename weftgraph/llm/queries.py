"""The registered queries of the text operators: each applies its operator to the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import langid, toxicity
from weftgraph.llm.bpe import encode_column
from weftgraph.llm.chat import as_events, format_conversations, read_loss, read_turns
from weftgraph.llm.common import documents, held_out, written
from weftgraph.llm.lines import drop_lines
from weftgraph.llm.media import wav_column, wav_fingerprints
from weftgraph.llm.minhash import near_duplicates
from weftgraph.llm.packing import pack_documents
from weftgraph.llm.phrases import mine_phrases
from weftgraph.llm.quality import quality_rules
from weftgraph.llm.quantize import books_sha256, quantize
from weftgraph.llm.sharding import shard_records
from weftgraph.llm.substring import remove_duplicate_spans


def tokenizer_path() -> str:
    """The public byte-level vocabulary that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that an earlier text holds are removed."""
    out = remove_duplicate_spans(documents(spark, sf_dir), "doc_id", "text", ["doc_id"], window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack_documents(documents(spark, sf_dir), "doc_id", "text", tokenizer_path())


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight equal shards by doc_id; sizes and checksums are taken before rows move, so texts are never shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shard_records(rows, "doc_id", [1.0] * 8, grown_weight=1.0, order_by=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition rules and cross-document line frequency per source."""
    out = quality_rules(documents(spark, sf_dir), "doc_id", "text", "source")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_share")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as 8-bit WAV, read back and fingerprinted; feature is the digest of the time-coded pairs."""
    media = wav_column(documents(spark, sf_dir), "text", ["doc_id"])
    out = wav_fingerprints(media, "media", ["doc_id", "n_bytes"])
    coded = F.zip_with("fp_times", "fp_codes", lambda t, c: F.concat_ws(":", t, c))
    return out.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        F.sha2(F.array_join(coded, ","), 256).alias("feature"),
        F.size("fp_codes").alias("n_pairs"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages learnt from the rows that are not held out, predicted for all."""
    docs = documents(spark, sf_dir)
    out = langid.predict_language(docs, "doc_id", "text", langid.train(docs, "doc_id", "text", "lang"), ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity learnt from the labelled rows that are not held out, scored for all."""
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text", "toxic")
    out = toxicity.score_toxicity(docs, "text", model, ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with similar sets of four-word shingles; the smallest document of each is kept."""
    out = near_duplicates(documents(spark, sf_dir), "doc_id", "text", words=4)
    return out.select(F.col("doc_key").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a smaller document holds are dropped; the digest is of the kept text."""
    out = drop_lines(documents(spark, sf_dir), "doc_id", "text", ["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    out = encode_column(documents(spark, sf_dir), "text", ["doc_id"], tokenizer_path(), decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most strongly bound phrases of two and three words of each language."""
    return mine_phrases(documents(spark, sf_dir), "lang", "text", max_n=3, least=10, covered_percent=50, most=2000)


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like the template, as a log of events; read back after formatting."""
    text = F.lit(r"\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    out = format_conversations(as_events(rows))
    read = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four bytes for all vectors, with their errors and those of their label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    coded, books = quantize(rows, "vec_id", "embedding", ["vec_id", "label"])
    if books is None:
        return coded.select("vec_id", "code", "error", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = written(coded, "codes")
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_best_fit_packing": op2_best_fit_packing, "op3_sharding": op3_sharding, "op4_quality_rules": op4_quality_rules, "op5_media": op5_media, "op6_language_id": op6_language_id, "op7_minhash_near_dedup": op7_minhash_near_dedup, "op8_line_dedup": op8_line_dedup, "op9_toxicity": op9_toxicity, "op10_bpe": op10_bpe, "op11_phrases": op11_phrases, "op12_chat": op12_chat, "op13_vector_codes": op13_vector_codes}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS key FROM w, unnest(range(1, len(ws) - 18)) AS t(i)),
        ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM windows),
        covered AS (SELECT DISTINCT doc_id, i + k AS i FROM ranked, unnest(range(0, 20)) AS t(k) WHERE r > 1),
        words AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(i)),
        judged AS (SELECT words.*, covered.i IS NOT NULL AS gone FROM words LEFT JOIN covered USING (doc_id, i)),
        sums AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
            FROM judged GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents LEFT JOIN sums USING (doc_id)
    """,
    "op4_quality_rules": f"""
        WITH w AS (SELECT doc_id, source, text, {_WORDS} AS ws FROM documents),
        grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 2], ' ')) AS n FROM w, unnest(range(1, len(ws) - 1)) AS t(i)),
        repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM grams, unnest(range(0, 3)) AS t(k) WHERE n > 1 GROUP BY doc_id),
        lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM documents),
        normal AS (
            SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS key
            FROM lines
        ),
        own AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM normal WHERE key <> '' GROUP BY doc_id),
        over AS (SELECT source, key FROM normal WHERE key <> '' GROUP BY source, key HAVING count(DISTINCT doc_id) > 10),
        gone AS (
            SELECT doc_id, sum(len(string_split(normal.key, ' '))) AS words FROM normal
            JOIN over ON normal.key = over.key AND normal.source IS NOT DISTINCT FROM over.source GROUP BY doc_id
        ),
        counts AS (
            SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum([length(x) for x in ws]), 0) AS BIGINT) AS word_chars,
                length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
                coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(words, 0) AS words
            FROM w LEFT JOIN own USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN gone USING (doc_id)
        ),
        failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN words = 0 THEN 0.0 ELSE CAST(words AS DOUBLE) / n_words END AS removed_share FROM counts)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND removed_share <= 0.7 AND n_words - words >= 50 AS kept, removed_share FROM failed
    """,
    "op7_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle
            FROM w, unnest(range(1, CASE WHEN len(ws) >= 4 THEN len(ws) - 2 WHEN len(ws) > 0 THEN 2 ELSE 1 END)) AS t(i)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
        groups AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM groups LEFT JOIN n USING (doc_id)
    """,
    "op11_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ),
        listed AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
        w AS (SELECT lang, id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM listed),
        runs AS (SELECT lang, x, x || ' ' || lead(x) OVER seq AS xy, x || ' ' || lead(x) OVER seq || ' ' || lead(x, 2) OVER seq AS xyz FROM w WINDOW seq AS (PARTITION BY lang, id ORDER BY i)),
        f AS MATERIALIZED (
            SELECT lang, x AS phrase, 1 AS k, count(*) AS f FROM runs GROUP BY ALL
            UNION ALL SELECT lang, xy, 2, count(*) FROM runs WHERE xy IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
            UNION ALL SELECT lang, xyz, 3, count(*) FROM runs WHERE xyz IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
        ),
        c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
        cuts AS MATERIALIZED (
            SELECT lang, phrase, a, 1 AS j, ws[1] AS head, array_to_string(ws[2:], ' ') AS rest FROM c
            UNION ALL SELECT lang, phrase, a, 2, array_to_string(ws[1:2], ' '), ws[3] FROM c WHERE k = 3
        ),
        keyed AS MATERIALIZED (SELECT lang || chr(9) || phrase AS key, f FROM f),
        scored AS (
            SELECT cuts.lang, cuts.phrase, a, j, h.f AS l, r.f AS r, CAST((a::HUGEINT * a::HUGEINT * 1000000) // (h.f::HUGEINT * r.f::HUGEINT) AS BIGINT) AS score
            FROM cuts JOIN keyed h ON h.key = cuts.lang || chr(9) || head JOIN keyed r ON r.key = cuts.lang || chr(9) || rest
        ),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        covers AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        left_over AS (SELECT best.* FROM best LEFT JOIN covers USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM left_over JOIN n USING (lang) QUALIFY rank <= 2000
    """,
    "op12_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
        ),
        m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t),
        g AS (
            SELECT conv_id, count(*) AS n_turns, sum(length(role) + length(text) + 16 + 2 * (length(text) - length(replace(replace(text, '\', ''), '<', ''))) // 2)::BIGINT AS formatted_chars,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
                coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (role = 'assistant'), '') AS loss
            FROM m GROUP BY conv_id
        )
        SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
    """,
    "op8_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (
            SELECT doc_id, pos, line,
                translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), firsts AS (
            SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
        ), judged AS (
            SELECT doc_id, pos, line, coalesce(doc_id > first_doc, false) AS dropped FROM keyed LEFT JOIN firsts USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
}
