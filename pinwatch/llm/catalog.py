"""The operators as queries over the given tables, with the DuckDB SQL that checks them where it can.

SQL is plain text over the tables by name. White space between words is 0x09-0x0D and 0x20.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pinwatch.llm import (
    cube_mix, exact, hard_negatives, jaccard, licenses, lm_counts, lm_score, packing, pieces, quality, ranked_search, substrings, token_rollup, url_filter,
)
from pinwatch.llm.encoders import vocabulary_path
from pinwatch.session import prepare, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(build: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return build(spark, lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return build

    return register


@query("op1_packing")
def op1_packing(spark, table):
    return packing.pack(table("documents"), vocabulary_path())


OP2_SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT id, doc_id, CASE WHEN len(words) >= 3 THEN list_distinct([hash(array_to_string(words[i:i+2], ' ')) for i in range(1, len(words) - 1)])
 WHEN len(words) > 0 THEN [hash(array_to_string(words, ' '))] ELSE [] END AS sh FROM d),
tokens AS (SELECT id, len(sh) AS n, unnest(sh) AS t FROM s),
counts AS (SELECT a.id AS u, b.id AS v, any_value(a.n) + any_value(b.n) AS n, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.id <> b.id GROUP BY a.id, b.id),
links AS (SELECT u, v FROM counts WHERE 100 * c >= 90 * (n - c)),
reach(id, other) AS (SELECT id, id FROM s UNION SELECT r.id, l.v FROM reach r JOIN links l ON l.u = r.other),
parts AS (SELECT r.id, min(s.doc_id) AS component_id FROM reach r JOIN s ON s.id = r.other GROUP BY r.id),
classes AS (SELECT id, CASE WHEN len(sh) > 0 THEN min(doc_id) OVER (PARTITION BY list_sort(sh)) ELSE doc_id END AS class_id FROM s)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, class_id FROM s JOIN parts USING (id) JOIN classes USING (id)"""


@query("op2_ngram_jaccard_join", OP2_SQL)
def op2_ngram_jaccard_join(spark, table):
    return jaccard.shingle_components(table("documents"), size=3, percent=90).drop("one", "two")


_LOSS = f"-ln(CASE WHEN c.n > 0 THEN {lm_score.BIGRAM_WEIGHT} * coalesce(b.n, 0) / c.n + {1 - lm_score.BIGRAM_WEIGHT:.10g} * u.p ELSE u.p END)"
OP3_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
raw AS (SELECT id, doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
vocabulary AS (SELECT word FROM (SELECT word, count(*) AS n FROM raw GROUP BY word ORDER BY n DESC, word LIMIT {lm_score.VOCABULARY})),
tokens AS (SELECT id, doc_id, i, coalesce(v.word, '') AS w, lag(coalesce(v.word, ''), 1, ' ') OVER (PARTITION BY id ORDER BY i) AS h
 FROM raw LEFT JOIN vocabulary v ON v.word = raw.word),
targets AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
kinds AS (SELECT *, 'b' AS kind FROM tokens UNION ALL SELECT *, 't' AS kind FROM tokens WHERE doc_id IN (SELECT doc_id FROM targets)),
bigrams AS (SELECT kind, h, w, count(*) AS n FROM kinds GROUP BY ALL),
contexts AS (SELECT kind, h, sum(n) AS n FROM bigrams GROUP BY ALL),
entries AS (SELECT word AS w FROM vocabulary UNION ALL SELECT ''),
k AS (SELECT unnest(['b', 't']) AS kind),
single AS (SELECT kind, w, (coalesce(n, 0) + 1.0) / (sum(coalesce(n, 0)) OVER (PARTITION BY kind) + count(*) OVER (PARTITION BY kind)) AS p
 FROM (SELECT k.kind, e.w, any_value(s.n) AS n FROM entries e CROSS JOIN k LEFT JOIN (SELECT kind, w, sum(n) AS n FROM bigrams GROUP BY ALL) s ON s.kind = k.kind AND s.w = e.w GROUP BY ALL)),
pairs AS (SELECT DISTINCT h, w FROM tokens),
loss AS (SELECT k.kind, p.h, p.w, {_LOSS} AS loss FROM pairs p CROSS JOIN k JOIN single u ON u.kind = k.kind AND u.w = p.w
 LEFT JOIN contexts c ON c.kind = k.kind AND c.h = p.h LEFT JOIN bigrams b ON b.kind = k.kind AND b.h = p.h AND b.w = p.w),
sums AS (SELECT t.id, avg(loss) FILTER (kind = 't') AS target, avg(loss) FILTER (kind = 'b') AS background FROM tokens t JOIN loss l ON l.h = t.h AND l.w = t.w GROUP BY t.id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_tokens, round(target, 6) AS target_loss, round(background, 6) AS background_loss,
 round(target - background, 6) AS difference FROM d LEFT JOIN sums s ON s.id = d.id"""


OP3_COUNTS_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
tokens AS (SELECT id, doc_id, unnest(list_prepend(' ', words)) AS h, unnest(list_append(words, '')) AS w FROM d WHERE len(words) > 0),
targets AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
counts AS (SELECT h, w, count(*) AS b, count(*) FILTER (doc_id IN (SELECT doc_id FROM targets)) AS t FROM tokens GROUP BY h, w),
contexts AS (SELECT h, sum(b) AS cb, sum(t) AS ct FROM counts GROUP BY h),
size AS (SELECT count(DISTINCT w) AS v FROM counts),
loss AS (SELECT h, w, -ln((t + {lm_counts.ADDED}::DOUBLE) / (ct + {lm_counts.ADDED}::DOUBLE * v)) AS target,
 -ln((b + {lm_counts.ADDED}::DOUBLE) / (cb + {lm_counts.ADDED}::DOUBLE * v)) AS background FROM counts JOIN contexts USING (h), size),
sums AS (SELECT id, avg(target) AS target, avg(background) AS background FROM tokens JOIN loss USING (h, w) GROUP BY id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_tokens, round(target, 6) AS target_loss, round(background, 6) AS background_loss,
 round(target - background, 6) AS difference FROM d LEFT JOIN sums s ON s.id = d.id"""


@query("op3_lm_scoring", OP3_COUNTS_SQL)
def op3_lm_scoring(spark, table):
    good = table("labels").filter("quality = 1 AND toxic = 0")
    return lm_counts.loss_difference(table("documents"), good)


@query("op3_lm_scoring_all_words", OP3_SQL.replace(f" ORDER BY n DESC, word LIMIT {lm_score.VOCABULARY}", ""))
def op3_lm_scoring_all_words(spark, table):
    """Bigrams mixed with single words in place of an amount added to all counts, joined row by row."""
    good = table("labels").filter("quality = 1 AND toxic = 0")
    return lm_score.cross_entropy_difference(table("documents"), good, None)


_HOST = r"lower(regexp_extract(url, '^(?:[^:]|:[^/]|:/[^/])*?://([^/?#]*)', 1, 's'))"
_PATH = r"regexp_extract(url, '^(?:[^:]|:[^/]|:/[^/])*?://[^/?#]*([^?#]*)', 1, 's')"
_SPLIT = f"SELECT page_id, url, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages"
_CANONICAL = r"""SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '')
 || regexp_replace(regexp_replace(path, '/+$', ''), '\.html$', '') END AS canonical FROM split"""
OP4_SQL = rf"""WITH split AS ({_SPLIT}), named AS ({_CANONICAL}),
listed AS (SELECT DISTINCT canonical FROM named
 WHERE try_cast(regexp_extract(canonical, '/([0-9]{{1,18}})$', 1) AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rules(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in url_filter.STATED_RULES)}),
fits AS (SELECT n.page_id, n.host, n.path, n.canonical, r.host || r.path AS rule, r.verdict AS ruled,
  row_number() OVER (PARTITION BY n.id ORDER BY length(r.host) DESC, length(r.path) DESC) AS place
 FROM (SELECT *, row_number() OVER () AS id FROM named) n LEFT JOIN rules r
 ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path))
SELECT page_id, host, path, rule, coalesce(canonical IN (SELECT canonical FROM listed), false) AS listed,
 coalesce(ruled, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM fits WHERE place = 1"""


@query("op4_url_filters", OP4_SQL)
def op4_url_filters(spark, table):
    pages = table("pages")
    listed = url_filter.pages_of_toxic_documents(pages, table("labels"))
    return url_filter.judge_urls(pages, url_filter.rule_table(spark), listed)


_TESTS = ", ".join(
    f"('{r.name}', {place}, {cut}, '{r.numerator}', '{r.denominator}')" for r in quality.RULES for place, cut in enumerate(r.cutoffs)
)
OP5_SQL = rf"""WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
places AS (SELECT id, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) > 4),
windows AS (SELECT id, i, array_to_string(words[i:i+4], ' ') AS w FROM places),
repeats AS (SELECT id, i, count(*) OVER (PARTITION BY id, w) AS n FROM windows),
steps AS (SELECT id, least(5, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i) - i, 5)) AS step FROM repeats WHERE n > 1),
covered AS (SELECT id, sum(step) AS n FROM steps GROUP BY id),
counts AS (SELECT s.id, s.doc_id, s.stratum, CAST(len(words) AS BIGINT) AS n_words,
 CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
 FROM split s LEFT JOIN covered c ON c.id = s.id),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
graded AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
holdout AS (SELECT b.*, g.good FROM based b JOIN graded g ON g.doc_id = b.doc_id WHERE NOT base_failed),
tests(rule, place, cutoff, num, den) AS (VALUES {_TESTS}),
long AS (SELECT stratum, good, t.rule, t.place, t.cutoff,
 100 * CASE num WHEN 'n_symbols' THEN n_symbols WHEN 'n_dup_lines' THEN n_dup_lines WHEN 'n_repeat_words' THEN n_repeat_words ELSE word_chars END
 > t.cutoff * CASE den WHEN 'n_words' THEN n_words ELSE n_lines END AS hit FROM holdout, tests t),
cells AS (SELECT stratum, rule, place, cutoff, count(*) FILTER (good) AS n_good, count(*) FILTER (good AND hit) AS wrong,
 count(*) FILTER (NOT good AND hit) AS correct FROM long GROUP BY ALL),
strata AS (SELECT stratum, any_value(n_good) AS n, {quality.ERROR_LEVEL} / ({len(quality.RULES)} * count(*) OVER ()) AS level FROM cells GROUP BY stratum),
terms AS (SELECT stratum, level, i, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.ALLOWED_RATE / len(quality.RULES)})
 + (n - i) * ln(1 - {quality.ALLOWED_RATE / len(quality.RULES)}))) OVER (PARTITION BY stratum ORDER BY i) AS total
 FROM (SELECT stratum, level, n, unnest(range(0, 1 + CAST(floor(n * {quality.ALLOWED_RATE / len(quality.RULES)}) AS BIGINT))) AS i FROM strata)),
most AS (SELECT stratum, coalesce(max(i) FILTER (total <= level), -1) AS k FROM terms GROUP BY stratum),
gains AS (SELECT c.*, correct - {quality.GOOD_WEIGHT} * wrong AS gain FROM cells c JOIN most m USING (stratum) WHERE wrong <= k),
chosen AS (SELECT stratum, rule, arg_max(cutoff, gain * 100 - place) AS cutoff FROM gains WHERE gain > 0 GROUP BY stratum, rule),
cuts AS (SELECT stratum, {", ".join(f"max(cutoff) FILTER (rule = '{r.name}') AS cut_{r.name}" for r in quality.RULES)} FROM chosen GROUP BY stratum)
SELECT doc_id, b.stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT ({" OR ".join(f"coalesce(100 * {r.numerator} > cut_{r.name} * {r.denominator}, false)" for r in quality.RULES)}) AS kept
FROM based b LEFT JOIN cuts ON cuts.stratum = b.stratum"""


@query("op5_quality_rules", OP5_SQL)
def op5_quality_rules(spark, table):
    return quality.quality_rules(table("documents"), table("labels")).drop("text_mark")


@query("op6_token_counts")
def op6_token_counts(spark, table):
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "token-rollup"))
    return token_rollup.corpus_history(table("documents"), rollup, vocabulary_path())


OP7_SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT id, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35),
windows AS (SELECT s.id, i, md5(array_to_string(words[i:i+34], ' ')) AS w FROM starts s JOIN d ON d.id = s.id),
repeated AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM repeated GROUP BY id),
kept AS (SELECT d.doc_id, words, gone, CASE WHEN gone IS NULL THEN words ELSE
 list_filter(words, lambda w, i: NOT list_contains(gone, i)) END AS rest FROM d LEFT JOIN covered c ON c.id = d.id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(rest) AS BIGINT) AS n_removed,
 sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept"""


@query("op7_substring_dedup", OP7_SQL)
def op7_substring_dedup(spark, table):
    return substrings.substring_duplicates(table("documents"))


OP8_SQL = """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
 row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)"""


@query("op8_exact_dedup", OP8_SQL)
def op8_exact_dedup(spark, table):
    return exact.exact_duplicates(table("documents"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark, table):
    return pieces.piece_report(table("documents"), vocabulary_path("piece_bpe_32k.model"), threads=2)


_NOTICES = ", ".join(f"({i}, '{name}', '{notice}')" for i, (name, notice) in enumerate(licenses.TEMPLATES))


def _license_words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+')"


def _five(words: str) -> str:
    return f"[array_to_string({words}[i:i+4], ' ') for i in range(1, len({words}) - 3)]"


OP10_SQL = f"""WITH notices(template, license, notice) AS (VALUES {_NOTICES}),
worded AS (SELECT template, license, {_license_words("notice")} AS words FROM notices),
templates AS (SELECT template, license, list_distinct({_five("words")}) AS sh FROM worded),
sized AS (SELECT *, len(sh) AS n, CASE WHEN len(sh) <= 1 THEN 2 WHEN len(sh) <= 2 THEN 4 WHEN len(sh) <= 4 THEN 8 WHEN len(sh) <= 8 THEN 16 WHEN len(sh) <= 16 THEN 32 ELSE 64 END AS width FROM templates WHERE len(sh) > 0),
d AS (SELECT row_number() OVER () AS id, doc_id, {_license_words("coalesce(text, '')")} AS words FROM documents),
tokens AS (SELECT id, doc_id, unnest({_five("d.words")}) AS t, unnest(range(len(words) - 4)) AS i FROM d WHERE len(words) > 4),
parts AS (SELECT template, license, n, width, unnest(sh) AS t FROM sized),
hits AS (SELECT k.id, k.doc_id, p.template, p.license, p.n, p.width, k.t, i, unnest([i // (width // 2), i // (width // 2) - 1]) * (width // 2) AS place
 FROM tokens k JOIN parts p ON p.t = k.t),
windows AS (SELECT id, doc_id, template, license, n, place, count(DISTINCT t) AS c FROM hits WHERE place >= 0 AND i < place + width GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY id, template ORDER BY c DESC, place) AS k FROM windows WHERE c >= {licenses.CONTAINED} * n)
SELECT doc_id, license, template, CAST(place AS INTEGER) AS place, round(c / n, 6) AS containment FROM best WHERE k = 1"""


@query("op10_license_scans", OP10_SQL)
def op10_license_scans(spark, table):
    return licenses.scan_licenses(table("documents"), licenses.template_table(spark))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_TERMS} AS terms FROM documents),
total AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark),
wanted AS (SELECT DISTINCT item, item_id, unnest(terms) AS term FROM i),
held AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term, n_docs),
sized AS (SELECT id, doc_id, 10 + (90 * CAST(len(terms) AS BIGINT) * n_docs) // n_terms AS m FROM d, total WHERE len(terms) > 0),
scored AS (SELECT item, item_id, id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
 FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN sized USING (id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""


@query("op11_ranked_search", OP11_SQL)
def op11_ranked_search(spark, table):
    return ranked_search.ranked_search(table("documents"), table("benchmark"))


@query("op12_cube_mix")
def op12_cube_mix(spark, table):
    return cube_mix.mixed_sources(table("documents"))


OP13_SQL = """WITH r AS (SELECT row_number() OVER () AS id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, a.vec_id AS anchor_id, b.id AS other, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
 FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM s WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
 s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score QUALIFY rank <= 10"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark, table):
    rows = table("embeddings")
    # The stated mislabelling: ids divisible by seven move on to the next label.
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved))
