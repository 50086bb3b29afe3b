"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses, rules
from .fingerprints import edit_fingerprints
from .licenses import license_report
from .mixing import BLOCK_WORDS, GOLDEN, mix_report
from .ngram_join import near_duplicate_classes
from .packing import pack
from .pii import pseudonymize_documents, session_key
from .quality import Resampler
from .repeats import remove_repeats
from .rules import quality_rules
from .warc import round_trip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Resampler(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).verdicts()


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_documents(spark, sf_dir), k=3, num=90, den=100)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(_documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_documents(spark, sf_dir))


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), window=35)


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize_documents(_documents(spark, sf_dir).select("doc_id", "text"), session_key(spark), report=True)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality_resampling": op2_quality_resampling,
    "op3_license_scan": op3_license_scan,
    "op6_quality_rules": op6_quality_rules,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_order_minhash": op5_order_minhash,
    "op10_source_mixing": op10_source_mixing,
    "op7_mixture_packing": op7_mixture_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_feistel_pseudonyms": op9_feistel_pseudonyms,
}

_SPACE = "[^ \\t\\n\\x0B\\f\\r]"


def _license_sql() -> str:
    """Every block against every template."""
    num, den = licenses.THRESHOLD
    sets = [(label, licenses.template_words(text)) for label, text in licenses.TEMPLATES]
    templates = ", ".join(f"('{label}', [{', '.join(repr(w) for w in words)}])" for label, words in sets)
    starts = []
    for phrase in licenses.PHRASES:
        words = phrase.split()
        here = " AND ".join(f"ws[i + {j + 1}] = '{w}'" for j, w in enumerate(words))
        starts.append(f"list_filter(range(0, len(ws) - {len(words) - 1}), lambda i: {here})")
    labels = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(licenses.PHRASES.values()))
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS ws FROM d),
        p AS (SELECT doc_id, t, ws, {", ".join(f"{x} AS p{i}" for i, x in enumerate(starts))} FROM w),
        b AS (SELECT doc_id, t, len(ws) AS n_words, list_concat({", ".join(f"p{i}" for i in range(len(starts)))}) AS places, list_filter([{labels}], lambda x: x IS NOT NULL) AS labels FROM p),
        l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS no FROM d),
        bl AS (SELECT doc_id, line FROM l UNION ALL SELECT doc_id, line || ' ' || lead(line) OVER (PARTITION BY doc_id ORDER BY no) FROM l),
        k AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{word}')) AS words FROM bl WHERE line IS NOT NULL),
        m AS (SELECT doc_id, label, len(list_intersect(words, tw)) AS common, len(tw) AS size FROM k, (VALUES {templates}) AS t(label, tw)),
        h AS (SELECT doc_id, list(DISTINCT label) AS found, max(common / CAST(size AS DOUBLE)) AS score FROM m WHERE common * {den} >= size * {num} GROUP BY 1)
        SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
               array_to_string(list_sort(list_distinct(labels)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(labels, coalesce(found, [])))), ',') AS labels, coalesce(score, 0.0e0) AS score
        FROM b LEFT JOIN h ON b.doc_id = h.doc_id
    """


def _rules_sql() -> str:
    """Histograms, references and distances, step by step. It expects one row for each doc_id."""
    counts, chain = [], []
    for i, pattern in enumerate(rules.CLASSES):
        chain.append(f"c{i + 1} AS (SELECT *, regexp_replace(r{i}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS r{i + 1} FROM c{i})")
        counts.append(f"length(r{i}) - length(r{i + 1})")
    last = len(rules.CLASSES)
    counts.append(f"length(r{last})")
    hits = [f"len(list_filter(ws, lambda x: x IN ({', '.join(repr(v) for v in dict.fromkeys((w, w.capitalize(), w.upper())))})))" for w in rules.COMMON_WORDS]

    def distance(histogram: str, total: str, reference: str) -> str:
        p, q = f"({histogram}[i] / CAST({total} AS DOUBLE))", f"{reference}[i]"
        m = f"(({p} + {q}) / 2)"
        term = f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0.0e0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0.0e0 END)"
        return f"CASE WHEN {total} > 0 AND {reference} IS NOT NULL THEN sqrt(greatest(0.0e0, list_sum(list_transform(range(1, len({reference}) + 1), lambda i: {term})) / 2)) END"

    def references(rows: str) -> str:
        chars = ", ".join(f"avg(chars[{i + 1}] / CAST(n_chars AS DOUBLE))" for i in range(last + 1))
        commons = ", ".join(f"avg(commons[{i + 1}] / CAST(n_words AS DOUBLE))" for i in range(len(rules.COMMON_WORDS) + 1))
        return f"(SELECT lang, [{chars}] AS cr, [{commons}] AS wr FROM {rows} GROUP BY lang)"

    char, common = distance("chars", "n_chars", "cr"), distance("commons", "n_words", "wr")
    return f"""
        WITH c0 AS (SELECT doc_id, lang, coalesce(text, '') AS text, coalesce(text, '') AS r0, regexp_extract_all(coalesce(text, ''), '{_SPACE}+') AS ws FROM documents), {", ".join(chain)},
        g AS (SELECT doc_id, i, (ws[i], ws[i + 1], ws[i + 2]) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM c0)),
        gg AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
        cv AS (SELECT doc_id, count(DISTINCT at_word) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS at_word FROM gg WHERE n > 1) GROUP BY 1),
        s AS (
            SELECT c.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACE}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')))) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(cv.n, 0) AS BIGINT) AS n_repeat_words, length(text) AS n_chars, [{", ".join(counts)}] AS chars, [{", ".join(hits)}] AS hits
            FROM c{last} c LEFT JOIN cv ON c.doc_id = cv.doc_id
        ),
        a AS (SELECT *, list_append(hits, CAST(n_words - list_sum(hits) AS BIGINT)) AS commons, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
        one AS (SELECT a.*, cr, wr FROM a LEFT JOIN {references("(SELECT * FROM a WHERE NOT base_failed)")} f ON f.lang IS NOT DISTINCT FROM a.lang),
        near AS (SELECT * EXCLUDE (cr, wr) FROM one WHERE NOT base_failed AND {char} <= {rules.NEAR}),
        two AS (SELECT o.* EXCLUDE (cr, wr), coalesce(f.cr, o.cr) AS cr, coalesce(f.wr, o.wr) AS wr FROM one o LEFT JOIN {references("near")} f ON f.lang IS NOT DISTINCT FROM o.lang),
        e AS (SELECT *, {char} AS char_distance, {common} AS word_distance FROM two)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce((n_chars >= {rules.MIN_CHARS} AND char_distance > {rules.CHAR_LIMIT}) OR (n_words >= {rules.MIN_WORDS} AND word_distance > {rules.WORD_LIMIT}), false) AS kept,
               round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
        FROM e
    """


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components_sql(k: int, num: int, den: int) -> str:
    """All pairs of different shingle sets that share a shingle, and the closure of their links. It expects one row for each doc_id."""
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE}+') AS ws FROM documents),
        s AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= {k} THEN list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))
                                                        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS shingles FROM w
        ),
        c AS (SELECT doc_id, shingles, len(shingles) AS n, CASE WHEN len(shingles) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY shingles) END AS class FROM s),
        x AS (SELECT class, n, unnest(shingles) AS shingle FROM c WHERE doc_id = class),
        l AS (
            SELECT a.class AS u, b.class AS v FROM x a JOIN x b ON a.shingle = b.shingle AND a.class < b.class
            GROUP BY a.class, b.class, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))
        ),
        e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
        reached(class, other) AS (SELECT class, class FROM c UNION SELECT r.class, e.v FROM reached r JOIN e ON e.u = r.other),
        m AS (SELECT class, min(other) AS least FROM reached GROUP BY class)
        SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CAST(least AS BIGINT) AS component_id FROM c JOIN m ON m.class = c.class
    """


def _repeats_sql(window: int) -> str:
    """Every window's words as they are, and how often they start anywhere. It expects one row for each doc_id."""
    return f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}+') AS ws FROM documents),
        t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
        g AS (
            SELECT doc_id, i, word, CASE WHEN count(*) OVER frame = {window} THEN string_agg(word, ' ') OVER frame END AS words FROM t
            WINDOW frame AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)
        ),
        r AS (SELECT doc_id, i, word, CASE WHEN words IS NOT NULL AND count(*) OVER (PARTITION BY words) > 1 THEN 1 ELSE 0 END AS again FROM g),
        v AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM r),
        k AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM v GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
    """


ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": _components_sql(3, 90, 100),
    "op8_substring_dedup": _repeats_sql(35),
    "op3_license_scan": _license_sql(),
    "op6_quality_rules": _rules_sql(),
    "op1_warc": """
        WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS bytes FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
        SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
               CASE WHEN bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op10_source_mixing": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS size FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source
        ), w AS (
            SELECT *, 1 + (no - 1) % 3 AS weight, 3.0e0 * source_size AS cap FROM s
        ), o AS (
            SELECT *, row_number() OVER (ORDER BY cap / weight, no) AS rank, sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS capped,
                   sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w
        ), l AS (
            SELECT ((SELECT sum(source_size) FROM s) - coalesce(capped, 0)) / weights AS level FROM o
            WHERE cap > ((SELECT sum(source_size) FROM s) - coalesce(capped, 0)) / weights * weight ORDER BY rank LIMIT 1
        ), t AS (
            SELECT w.no, w.source, w.source_size, least(cap, coalesce((SELECT level FROM l) * weight, cap)) AS target FROM w
        ), p AS (
            SELECT d.doc_id, d.size, t.no - 1 AS no, t.source_size, t.target,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.size
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), k AS (
            SELECT DISTINCT t.no - 1 AS no, t.source, t.source_size, CAST(round_even(t.target, 0) AS BIGINT) AS wanted, (t.source_size + {block} - 1) // {block} AS blocks FROM t
        ), n AS (
            SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size * blocks + (wanted % source_size + {block} - 1) // {block} ELSE 0 END AS slots FROM k
        ), e AS (
            SELECT *, sum(slots) OVER (ORDER BY no) / CAST((SELECT sum(slots) FROM n) AS DOUBLE) AS upper FROM n
        ), r AS (  -- the schedule: slot i falls where the fractional part of (i + 1/2) times the golden ratio lies
            SELECT i, (i + 0.5e0) * {golden}e0 - floor((i + 0.5e0) * {golden}e0) AS point FROM range(CAST((SELECT sum(slots) FROM n) AS BIGINT)) AS x(i)
        ), f AS (
            SELECT i, (SELECT least(count(*), (SELECT max(no) FROM n)) FROM e WHERE upper <= point) AS no FROM r
        ), g AS (
            SELECT i AS slot, no, row_number() OVER (PARTITION BY no ORDER BY i) - 1 AS rank FROM f
        ), y AS (  -- what a source lacks comes after
            SELECT * FROM g
            UNION ALL
            SELECT (SELECT count(*) FROM r) + n.no, n.no, unnest(range(CAST(coalesce(h.had, 0) AS BIGINT), CAST(n.slots AS BIGINT))) FROM n LEFT JOIN (SELECT no, count(*) AS had FROM g GROUP BY no) h ON h.no = n.no
        ), z AS (
            SELECT y.slot, n.no, rank % blocks AS block_no,
                   least({block}, source_size - rank % blocks * {block}, wanted - (rank // blocks * source_size + rank % blocks * {block})) AS words
            FROM y JOIN n ON n.no = y.no WHERE rank < slots
        ), b AS (
            SELECT p.*, unnest(range(CAST(start // {block} AS BIGINT), CAST((start + size - 1) // {block} + 1 AS BIGINT))) AS block_no FROM p WHERE size > 0
        ), o2 AS (
            SELECT b.doc_id, b.size, b.start, b.source_size, b.no, b.target, z.slot,
                   CASE WHEN z.words IS NULL THEN 0 ELSE greatest(0, least(b.start + b.size, b.block_no * {block} + z.words) - greatest(b.start, b.block_no * {block})) END AS overlap
            FROM b LEFT JOIN z ON z.no = b.no AND z.block_no = b.block_no
        )
        SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(sum(coalesce(overlap, 0)) AS BIGINT) AS taken, CAST(min(CASE WHEN overlap > 0 THEN slot END) AS BIGINT) AS first_slot
        FROM o2 GROUP BY no, start, doc_id, size, source_size, target
        UNION ALL
        SELECT doc_id, size, source_size, round(target, 6), CAST(0 AS BIGINT), NULL FROM p WHERE size = 0
    """.replace("{block}", str(BLOCK_WORDS)).replace("{golden}", repr(GOLDEN)),
}
