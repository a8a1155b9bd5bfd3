"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from importflow.llm import (
    digest, html_text, jaccard, language, lengths, mixing, packing, periods, pitman_yor, quality_rules, secrets,
    substrings, tries,
)
from importflow.session import store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ipf_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_wrapper_induction(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_ngram_jaccard(spark, sf_dir):
    return jaccard.join_components(_table(spark, sf_dir, "documents"))


def op4_hilbert_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_quartile_digest(spark, sf_dir):
    return digest.compare_neighbours(_table(spark, sf_dir, "documents"))


def op6_crf_secrets(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    return secrets.summary(secrets.scan(documents, secrets.learn(documents)))


def op7_token_lengths(spark, sf_dir):
    return lengths.answers(store(lengths.histogram(_table(spark, sf_dir, "documents")), "lengths"))


def op8_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), digest=True)


def op9_language_id(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    model = language.learn(documents.where(~F.col("held_out")))
    return language.identify(documents.select("doc_id", "held_out", "text"), model).drop("text")


def op10_quality_rules(spark, sf_dir):
    measured = quality_rules.with_measures(_table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return quality_rules.judge(store(measured, "measures"), "source").drop("source")


def op11_periodic_runs(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = documents.withColumn("text", periods.rewritten("doc_id", "text"))
    return periods.summary(periods.with_runs(changed, keep=["doc_id"]))


def op12_pitman_yor(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    train = ~pitman_yor.held_out()
    return pitman_yor.score(documents, pitman_yor.learn(documents.where(train)), train)


def op13_conversation_trie(spark, sf_dir):
    return tries.prefix_trie(_table(spark, sf_dir, "conversations"))


WORD = r"[^\x20\x09-\x0D]+"


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, byte by byte and bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    bits = "list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda crc, b: {bits}), 4294967295)"


QUERIES = {
    "op1_ipf_mixing": op1_ipf_mixing,
    "op2_wrapper_induction": op2_wrapper_induction,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_hilbert_packing": op4_hilbert_packing,
    "op5_quartile_digest": op5_quartile_digest,
    "op6_crf_secrets": op6_crf_secrets,
    "op7_token_lengths": op7_token_lengths,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_pitman_yor": op12_pitman_yor,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES = {
    "op3_ngram_jaccard": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
            FROM documents),
        s AS (SELECT DISTINCT doc_id, sh FROM (
                SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
                    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS sh FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
                   FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                  WHERE 100 * c >= 85 * (x.n + y.n - c)),
        tied AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS r FROM documents UNION
                  SELECT reach.doc_id, tied.b FROM reach JOIN tied ON tied.a = reach.r)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.r) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.doc_id = d.doc_id
        GROUP BY d.doc_id, n.n""",
    "op8_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
        win AS (SELECT doc_id, i, ws[i:i + 19] AS win FROM w, unnest(range(1, len(ws) - 18)) AS t(i)),
        ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM win),
        gone AS (SELECT DISTINCT doc_id, i + k AS j FROM ranked, unnest(range(20)) AS t(k) WHERE r > 1),
        flat AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
        marked AS (SELECT flat.doc_id, flat.j, word, gone.j IS NOT NULL AS out
                   FROM flat LEFT JOIN gone ON gone.doc_id = flat.doc_id AND gone.j = flat.j),
        done AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (out) AS n_removed,
                        string_agg(word, ' ' ORDER BY j) FILTER (NOT out) AS kept FROM marked GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id""",
    "op10_quality_rules": rf"""
        WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text,
                          regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
        win AS (SELECT doc_id, i, ws[i:i + 2] AS win FROM w, unnest(range(1, len(ws) - 1)) AS t(i)),
        often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, unnest(range(3)) AS t(k)
                WHERE c > 1 GROUP BY doc_id),
        line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w),
        again AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM line),
        dup AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (r > 1) AS n FROM again
                WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
        m AS (SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
                     CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
                     coalesce(dup.lines, 0) AS n_lines
              FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                     CAST(n_words < 50 AS BIGINT) + CAST(100 * n_repeat_words > 50 * n_words AS BIGINT)
                     + CAST(100 * n_symbols > 10 * n_words AS BIGINT) + CAST(100 * n_dup_lines > 30 * n_lines AS BIGINT)
                     + CAST(word_chars < 3 * n_words OR word_chars > 10 * n_words AS BIGINT) AS rules_failed FROM m),
        hosts AS (SELECT source, count(*) AS n, count(*) FILTER (rules_failed > 0) AS f FROM f GROUP BY source),
        total AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS h, sum(f * f / n) AS q FROM hosts),
        moments AS (SELECT f / n AS mean, f / n * (1 - f / n) AS chance,
                           (q - f * (f / n) - f / n * (1 - f / n) * (h - 1)) / n AS rest FROM total),
        prior AS (SELECT mean, chance, CASE WHEN rest > 0 THEN least(greatest(chance / rest - 1, 1), 1e6) ELSE 1e6 END AS weight
                  FROM moments),
        verdict AS (SELECT source, (f + mean * weight) / (n + weight)
                           <= greatest(0.5, least(0.8, mean + 2 * sqrt(chance / (weight + 1)))) AS ok
                    FROM hosts, prior)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
               NOT base_failed AND ok AS kept, rules_failed
        FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source""",
    # Two places with the same six words are a lag apart; every run holds such pairs without a gap, since of its
    # max(12, 2p) words at least max(12 - p, p) >= 6 equal the word one period on.
    "op11_periodic_runs": rf"""
        WITH given AS (SELECT doc_id, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h,
                              regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
        turned AS (SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a FROM given),
        period AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM turned),
        w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n),
                     lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM period),
        grams AS (SELECT doc_id, i - 1 AS i, ws[i:i + 5] AS g FROM w, unnest(range(1, n - 4)) AS t(i)),
        pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM grams x JOIN grams y
                  ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
        islands AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM pairs),
        stretches AS (SELECT doc_id, p, min(i) AS start, max(i) + 6 - min(i) + p AS length
                      FROM islands GROUP BY doc_id, p, k),
        runs AS (SELECT doc_id, start, length, min(p) AS p FROM stretches
                 WHERE length >= greatest(12, 2 * p) GROUP BY doc_id, start, length),
        told AS (SELECT doc_id, count(*) AS n_runs,
                        string_agg(start || ',' || length || ',' || p || chr(10), '' ORDER BY start, p) AS lines
                 FROM runs GROUP BY doc_id),
        best AS (SELECT doc_id, start, length, p, row_number() OVER (
                     PARTITION BY doc_id ORDER BY length DESC, start, p) AS r FROM runs),
        gone AS (SELECT DISTINCT doc_id, j FROM runs, unnest(range(start + p, start + length)) AS t(j)),
        flat AS (SELECT doc_id, unnest(ws) AS word, unnest(range(n)) AS j FROM w),
        kept AS (SELECT flat.doc_id, string_agg(word, ' ' ORDER BY flat.j) AS whole FROM flat
                 ANTI JOIN gone ON gone.doc_id = flat.doc_id AND gone.j = flat.j GROUP BY flat.doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.p AS period,
               1000 * best.length // best.p AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(whole, '')) AS collapsed_sha256
        FROM documents d LEFT JOIN told ON told.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
        LEFT JOIN best ON best.doc_id = d.doc_id AND best.r = 1""",
    "op13_conversation_trie": f"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM t WHERE pos = 1),
        r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t
              ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h
              UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
        s AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, pos) AS s FROM r GROUP BY conv_id),
        whole AS (SELECT conv_id, coalesce(s, []) AS s FROM c LEFT JOIN s USING (conv_id)),
        steps AS (SELECT conv_id, len(s) AS n, d AS depth, s[:d] AS prefix, length(s[d].text) AS chars
                  FROM whole, unnest(range(len(s) + 1)) AS x(d)),
        m AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM steps),
        nodes AS (SELECT depth, node, count(*) AS n_convs, coalesce(max(chars), 0) AS chars,
                         string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = depth) AS ends FROM m GROUP BY depth, node),
        linked AS (SELECT nodes.*, up.node AS parent FROM nodes LEFT JOIN m up
                   ON up.conv_id = nodes.node AND up.depth = nodes.depth - 1),
        kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL),
        own AS (SELECT linked.*, coalesce(kids.n, 0) AS n_children FROM linked
                LEFT JOIN kids ON kids.depth = linked.depth AND kids.node = linked.node),
        totals AS (SELECT m.depth, m.node, count(*) FILTER (own.n_children = 0) AS n_leaves,
                          CAST(sum((own.n_convs - 1) * own.chars) AS BIGINT) AS saved
                   FROM own JOIN m ON m.conv_id = own.node AND m.depth <= own.depth GROUP BY ALL)
        SELECT own.node AS conv_id, own.depth, own.parent AS parent_conv_id, n_convs, n_children, n_leaves,
               saved AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
        FROM own JOIN totals ON totals.depth = own.depth AND totals.node = own.node""",
}
