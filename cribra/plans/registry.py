"""All core queries by name, each beside its SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cribra.axes import AXES
from cribra.functions import responses, text, urls
from cribra.functions.patterns import AFTER_AUTHORS, NOISE_SECTIONS, STEPS, spell
from cribra.operators import discovery, evaluation, ledger, partition, scores
from cribra.tables import materialize, table

FLAGSHIP = "clean_keep_stats"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- SQL fragments -------------------------------------------------------------------------------------------------

_WS = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A{_WS}|{_WS}\z', '', 'g')"


def _steps(c: str, steps) -> str:
    for _, flags, template, repl, once in steps:
        c = f"regexp_replace({c}, '{_q(spell(template, flags, 're2'))}', '{repl}'{'' if once else ', ' + chr(39) + 'g' + chr(39)})" if "\n" not in repl else f"regexp_replace({c}, '{_q(spell(template, flags, 're2'))}', repeat(chr(10), {len(repl)}), 'g')"
    return c


def _no_authors(c: str, authors: str = "authors") -> str:
    names = f"list_filter(list_transform(coalesce({authors}, []), lambda a: lower({_strip('a')})), lambda a: a <> '')"
    kept = f"list_filter(string_split({c}, chr(10)), lambda l: lower({_strip('l')}) = '' OR NOT coalesce(list_contains({names}, lower({_strip('l')})), false))"
    return f"CASE WHEN len({names}) > 0 THEN array_to_string({kept}, chr(10)) ELSE {c} END"


CLEANED = f"""WITH a AS (SELECT *, {_steps('text', STEPS)} AS t1 FROM labeled_news),
b AS (SELECT * EXCLUDE (t1), {_no_authors('t1')} AS t2 FROM a),
cleaned AS (SELECT * EXCLUDE (t2), {_strip(_steps('t2', AFTER_AUTHORS))} AS clean FROM b)"""

_SECTION = r"lower(regexp_extract(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '(?s)[?#].*$', ''), '^//[^/]*', ''), '^/*([^/]*)', 1))"
SECTION = f"CASE WHEN url IS NULL OR {_SECTION} = '' THEN 'root' ELSE {_SECTION} END"
NOISE = ", ".join(f"'{s}'" for s in NOISE_SECTIONS)
LONG = "(SELECT article_id, is_political, unnest([" + ", ".join(f"{{'pos': {i}, 'axis': '{a}', 'score': coalesce({a}, 0.0::DOUBLE)}}" for i, a in enumerate(AXES)) + "], recursive := true) FROM labeled_news)"
POLITICAL = f"(SELECT * FROM {LONG} WHERE is_political = 1)"


def news(s: SparkSession, d: str, *columns: str) -> DataFrame:
    t = table(s, d, "labeled_news")
    return t.select(*columns) if columns else t


def cleaned(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """labeled_news with clean; a small file is one task, so it is spread before the costly expressions."""
    t = news(s, d, "text", "authors", *columns).repartition(max(s.sparkContext.defaultParallelism, 1))
    return text.barrier(t, "clean", text.clean_article(F.col("text"), F.col("authors"))).select("clean", "text", *columns)


# ---- cleaning ------------------------------------------------------------------------------------------------------


@query(f"""{CLEANED}, o AS (SELECT *, {SECTION} AS section FROM cleaned),
p AS (SELECT *, CASE WHEN section IN ({NOISE}) THEN 'noise' WHEN clean IS NULL OR length(clean) < 300 THEN 'short' ELSE 'kept' END AS st, md5(clean) AS h FROM o),
r AS (SELECT *, CASE WHEN st = 'kept' AND row_number() OVER (PARTITION BY st, h ORDER BY article_id) > 1 THEN 'repeat' ELSE st END AS outcome FROM p)
SELECT source, outcome, CAST(count(*) AS BIGINT) AS articles, CAST(sum(coalesce(length(clean), 0)) AS BIGINT) AS chars FROM r GROUP BY source, outcome""")
def clean_keep_stats(s, d):
    c = cleaned(s, d, "article_id", "source", "url")
    st = F.when(urls.is_noise(F.col("url")), "noise").when(F.coalesce(F.length("clean"), F.lit(0)) < 300, "short").otherwise("kept")
    slim = materialize(c.select("article_id", "source", st.alias("st"), F.md5("clean").alias("h"), F.coalesce(F.length("clean"), F.lit(0)).alias("n")), "outcomes")
    first = slim.where("st = 'kept'").groupBy("h").agg(F.min("article_id").alias("first"))
    j = slim.join(first, "h", "left")
    outcome = F.when((F.col("st") == "kept") & (F.col("first") < F.col("article_id")), "repeat").otherwise(F.col("st"))
    return j.groupBy("source", outcome.alias("outcome")).agg(F.count("*").alias("articles"), F.sum("n").cast("bigint").alias("chars"))


@query(f"{CLEANED} SELECT article_id, clean FROM cleaned")
def clean_text_full(s, d):
    return cleaned(s, d, "article_id").select("article_id", "clean")


@query("SELECT article_id, " + ", ".join(f"(t{i} IS DISTINCT FROM t{i - 1}) AS {st[0].lower()}" for i, st in enumerate(STEPS, 1)) + " FROM " + _steps("", ())
       + "".join(f"(SELECT *, {_steps(f't{i - 1}', [st])} AS t{i} FROM " for i, st in reversed(list(enumerate(STEPS, 1)))) + "(SELECT article_id, text AS t0 FROM labeled_news)" + ")" * len(STEPS))
def clean_steps_fired(s, d):
    """Which steps change a text, each applied to what the ones before it left."""
    df = news(s, d, "article_id", "text").repartition(s.sparkContext.defaultParallelism).withColumnRenamed("text", "t")
    for st in STEPS:
        df = df.select("*", F.explode(F.array(text.apply_steps(F.col("t"), [st]))).alias("n")).withColumn(st[0].lower(), ~F.col("n").eqNullSafe(F.col("t"))).drop("t").withColumnRenamed("n", "t")
    return df.drop("t")


@query(f"SELECT article_id, {_no_authors('text')} AS text FROM labeled_news")
def author_lines_removed(s, d):
    return news(s, d, "article_id", "text", "authors").select("article_id", text.without_author_lines(F.col("text"), F.col("authors")).alias("text"))


@query("SELECT article_id, CAST(length(text) AS INTEGER) AS n FROM labeled_news WHERE length(text) >= 400")
def min_length_400(s, d):
    return news(s, d, "article_id", "text").select("article_id", F.length("text").alias("n")).where("n >= 400")


@query(f"{CLEANED} SELECT article_id, CAST(length(clean) AS INTEGER) AS n FROM cleaned WHERE length(clean) >= 300")
def min_length_300_clean(s, d):
    return cleaned(s, d, "article_id").select("article_id", F.length("clean").alias("n")).where("n >= 300")


@query(f"""{CLEANED}, o AS (SELECT CASE WHEN {SECTION} IN ({NOISE}) THEN 'noise' WHEN clean IS NULL OR length(clean) < 300 THEN 'short' ELSE 'kept' END AS outcome FROM cleaned)
SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY outcome""")
def clean_counters(s, d):
    c = cleaned(s, d, "url")
    return c.groupBy(F.when(urls.is_noise(F.col("url")), "noise").when(F.coalesce(F.length("clean"), F.lit(0)) < 300, "short").otherwise("kept").alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT article_id, substring(text, 1, 8000) AS judge_text, substring(text, 1, 1500) AS filter_text FROM labeled_news")
def truncate_text(s, d):
    return news(s, d, "article_id", "text").select("article_id", text.prefix(F.col("text"), 8000).alias("judge_text"), text.prefix(F.col("text"), 1500).alias("filter_text"))


@query("SELECT scrape_id, CASE WHEN length(url) > 90 THEN substring(url, 1, 87) || '...' ELSE url END AS shown FROM scraped_urls")
def ellipsis(s, d):
    return table(s, d, "scraped_urls").select("scrape_id", text.ellipsis(F.col("url")).alias("shown"))


@query(f"SELECT article_id, array_to_string(list_filter(list_transform(string_split(array_to_string(coalesce(authors, []), ';'), ';'), lambda a: {_strip('a')}), lambda a: a <> ''), '|') AS names FROM labeled_news")
def author_split(s, d):
    return news(s, d, "article_id", "authors").select("article_id", F.array_join(text.split_authors(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ";")), "|").alias("names"))


# ---- urls, ledger --------------------------------------------------------------------------------------------------


@query(f"SELECT scrape_id, {SECTION} AS section FROM scraped_urls")
def url_section(s, d):
    return table(s, d, "scraped_urls").select("scrape_id", urls.url_section(F.col("url")).alias("section"))


@query(f"SELECT scrape_id, url FROM scraped_urls WHERE ({SECTION}) NOT IN ('paz', 'economia', {NOISE})")
def noise_section_filter(s, d):
    """The sections to leave out are a parameter; these tables have none of the usual ones, so two more are named."""
    return table(s, d, "scraped_urls").where(~urls.is_noise(F.col("url"), ("paz", "economia", *NOISE_SECTIONS))).select("scrape_id", "url")


@query("""SELECT scrape_id, u.url FROM scraped_urls u JOIN sources c ON u.source = c.name
WHERE c.mode <> 'sitemap' OR len(coalesce(c.url_filters, [])) = 0 OR len(list_filter(c.url_filters, lambda f: contains(lower(u.url), lower(f)))) > 0""")
def url_allowlist(s, d):
    u, c = table(s, d, "scraped_urls").select("scrape_id", "url", "source"), table(s, d, "sources").select(F.col("name").alias("source"), "mode", "url_filters")
    return u.join(c, "source").where((F.col("mode") != "sitemap") | urls.passes_filters(F.col("url"), F.col("url_filters"))).select("scrape_id", "url")


@query(r"SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)) AS host, CAST(count(*) AS BIGINT) AS n FROM scraped_urls GROUP BY 1")
def url_hosts(s, d):
    return table(s, d, "scraped_urls").groupBy(urls.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(text) AS hash FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def content_hash_dedup(s, d):
    df = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5("text").alias("hash"))
    return df.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT article_id, url FROM labeled_news n WHERE url IS NULL OR NOT EXISTS (SELECT 1 FROM scraped_urls s WHERE s.url = n.url)")
def ledger_anti_join(s, d):
    return ledger.not_in_ledger(news(s, d, "article_id", "url"), table(s, d, "scraped_urls").select("url"), "url")


# a loop over the rows that share a url or a hash with others, all others being accepted
@query("""WITH RECURSIVE shared AS (SELECT scrape_id, url, content_hash, count(url) OVER (PARTITION BY url) AS nu, count(content_hash) OVER (PARTITION BY content_hash) AS nh FROM scraped_urls),
t AS (SELECT row_number() OVER (ORDER BY scrape_id) AS i, scrape_id, 'u' || url AS u, 'h' || content_hash AS h FROM shared WHERE nu > 1 OR nh > 1),
r AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS seen, []::BIGINT[] AS took UNION ALL
  SELECT t.i, CASE WHEN coalesce(list_contains(seen, u), false) OR coalesce(list_contains(seen, h), false) THEN seen ELSE list_concat(seen, list_filter([u, h], lambda x: x IS NOT NULL)) END,
    CASE WHEN coalesce(list_contains(seen, u), false) OR coalesce(list_contains(seen, h), false) THEN took ELSE list_append(took, scrape_id) END FROM r JOIN t ON t.i = r.i + 1),
done AS (SELECT unnest(took) AS scrape_id FROM (SELECT took FROM r ORDER BY i DESC LIMIT 1))
SELECT scrape_id, url, content_hash FROM shared WHERE nu <= 1 AND nh <= 1 OR scrape_id IN (SELECT scrape_id FROM done)""")
def ledger_first_wins(s, d):
    df = table(s, d, "scraped_urls").select("scrape_id", "url", "content_hash")
    return ledger.accept(df, df.limit(0), ["scrape_id"])


@query("""SELECT url, source, scrape_id FROM (SELECT url, source, scrape_id FROM scraped_urls WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY scrape_id) = 1)
UNION ALL SELECT url, source, -article_id AS scrape_id FROM (SELECT url, source, article_id FROM labeled_news n WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM scraped_urls s WHERE s.url = n.url) QUALIFY row_number() OVER (PARTITION BY url ORDER BY article_id) = 1)""")
def ledger_upsert(s, d):
    led = ledger.first_wins(table(s, d, "scraped_urls").where("url IS NOT NULL").select("url", "source", "scrape_id"), ["url"], ["scrape_id"])
    new = ledger.first_wins(news(s, d, "url", "source", "article_id").where("url IS NOT NULL"), ["url"], ["article_id"]).select("url", "source", (-F.col("article_id")).alias("scrape_id"))
    return ledger.upsert(led, new)


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT url) AS BIGINT) AS urls FROM scraped_urls")
def ledger_count(s, d):
    return table(s, d, "scraped_urls").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


# ---- responses -----------------------------------------------------------------------------------------------------

_UNWRAPPED = f"(SELECT article_id, received_at, {_strip('''CASE WHEN contains(r, '```json') THEN split_part(split_part(r, '```json', 2), '```', 1) WHEN contains(r, '```') THEN split_part(r, '```', 2) ELSE r END''')} AS t FROM (SELECT *, {_strip('response')} AS r FROM %s))"
_JSON = "(SELECT *, CASE WHEN json_valid(t) AND starts_with(t, '{') THEN CAST(t AS JSON) END AS j FROM " + _UNWRAPPED + ")"
_NUM = "('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE', 'BOOLEAN')"


def _jnum(k: str) -> str:
    return f"CASE json_type(j, '$.{k}') WHEN 'BOOLEAN' THEN CASE WHEN CAST(json_extract(j, '$.{k}') AS BOOLEAN) THEN 1.0 ELSE 0.0 END ELSE TRY_CAST(json_extract_string(j, '$.{k}') AS DOUBLE) END"


JUDGED = f"""(SELECT article_id, received_at, p AS is_political, {', '.join(f'greatest(0.0, least(100.0, {_jnum(a)})) AS {a}' for a in AXES)} FROM
(SELECT *, CASE WHEN json_type(j, '$.is_political') IN {_NUM} THEN CAST(trunc({_jnum('is_political')}) AS INTEGER) ELSE TRY_CAST(json_extract_string(j, '$.is_political') AS INTEGER) END AS p FROM {_JSON % 'judge_responses'})
WHERE p IS NOT NULL AND {' AND '.join(f"coalesce(json_type(j, '$.{a}') IN {_NUM}, false)" for a in AXES)})"""


@query(f"SELECT article_id, received_at, t AS body FROM {_UNWRAPPED % 'judge_responses'}")
def judge_unwrap(s, d):
    return table(s, d, "judge_responses").select("article_id", "received_at", responses.unwrap(F.col("response")).alias("body"))


def _judged(s, d):
    r = table(s, d, "judge_responses")
    return responses.with_parsed(r, "response", responses.judge).where("p IS NOT NULL").select("article_id", "received_at", "p")


@query(f"SELECT article_id, received_at, is_political, {', '.join(f'round_even({a} / 100, 4) AS {a}' for a in AXES)} FROM {JUDGED}")
def judge_parse_normalize(s, d):
    return _judged(s, d).select("article_id", "received_at", responses.normalise(F.col("p")).alias("n")).select("article_id", "received_at", "n.*")


@query(f"SELECT r.article_id, CAST(count(*) AS BIGINT) AS tries, CAST(count(j.article_id) AS BIGINT) AS valid FROM judge_responses r LEFT JOIN {JUDGED} j ON r.article_id = j.article_id AND r.received_at IS NOT DISTINCT FROM j.received_at GROUP BY r.article_id HAVING count(j.article_id) < count(*)")
def judge_dead_letters(s, d):
    """Articles with responses that can't be used: the dead-letter side of labelling."""
    r = responses.with_parsed(table(s, d, "judge_responses"), "response", responses.judge).select("article_id", F.col("p").isNotNull().alias("ok"))
    return r.groupBy("article_id").agg(F.count("*").alias("tries"), F.count_if("ok").alias("valid")).where("valid < tries")


@query(f"SELECT article_id, CAST(count(*) AS BIGINT) AS n FROM {JUDGED} WHERE is_political = 0 AND ({' + '.join(AXES)}) > 0 GROUP BY article_id")
def judge_nonpolitical_scores(s, d):
    """Responses that call a text not political and yet score it."""
    return _judged(s, d).where(F.expr("p.is_political = 0 AND " + " + ".join(f"p.{a}" for a in AXES) + " > 0")).groupBy("article_id").agg(F.count("*").alias("n"))


_FILTERED = f"""(SELECT article_id, received_at, CASE json_type(j, '$.is_article') WHEN 'BOOLEAN' THEN json_extract_string(j, '$.is_article') = 'true' WHEN 'VARCHAR' THEN json_extract_string(j, '$.is_article') <> '' WHEN 'NULL' THEN false ELSE coalesce(TRY_CAST(json_extract_string(j, '$.is_article') AS DOUBLE) <> 0, true) END AS is_article,
json_extract_string(j, '$.category') AS category, json_extract_string(j, '$.reason') AS reason FROM {_JSON % 'filter_responses'} WHERE json_type(j, '$.is_article') IS NOT NULL AND json_type(j, '$.category') IS NOT NULL)"""


def _filtered(s, d):
    return responses.with_parsed(table(s, d, "filter_responses"), "response", responses.verdict).select("article_id", "received_at", "p")


@query(f"SELECT article_id, received_at, is_article, category, reason FROM {_FILTERED}")
def filter_parse(s, d):
    return _filtered(s, d).where("p IS NOT NULL").select("article_id", "received_at", "p.*")


@query(f"""{CLEANED} SELECT CASE WHEN coalesce(length(c.clean), 0) < 300 THEN 'too_short_after_clean' WHEN f.article_id IS NULL THEN 'error' WHEN f.is_article THEN 'kept' ELSE f.category END AS outcome, CAST(count(*) AS BIGINT) AS n
FROM cleaned c LEFT JOIN {_FILTERED} f USING (article_id) GROUP BY 1""")
def filter_outcomes(s, d):
    c = cleaned(s, d, "article_id").select("article_id", F.coalesce(F.length("clean"), F.lit(0)).alias("n"))
    j = c.join(_filtered(s, d).where("p IS NOT NULL").select("article_id", "p"), "article_id", "left")
    return j.groupBy(F.when(F.col("n") < 300, "too_short_after_clean").when(F.col("p").isNull(), "error").when(F.col("p.is_article"), "kept").otherwise(F.col("p.category")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"SELECT f.article_id, f.category, substring(f.reason, 1, 100) AS reason, substring(n.url, 1, 80) AS url FROM {_FILTERED} f JOIN labeled_news n USING (article_id) WHERE NOT is_article ORDER BY f.article_id LIMIT 15")
def discard_examples(s, d):
    """The first fifteen discarded articles, as the run's report shows them."""
    f = _filtered(s, d).where("p IS NOT NULL AND NOT p.is_article").select("article_id", "p.category", text.prefix(F.col("p.reason"), 100).alias("reason"))
    return f.join(news(s, d, "article_id", "url"), "article_id").select("article_id", "category", "reason", text.prefix(F.col("url"), 80).alias("url")).orderBy("article_id").limit(15)


@query(r"SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(s, d):
    return table(s, d, "events").select("event_id", "event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


# ---- scores --------------------------------------------------------------------------------------------------------


def _long(s, d, only_political=True):
    t = news(s, d, "article_id", "is_political", *AXES)
    return scores.to_long(scores.political(t) if only_political else t, ["article_id"])


@query(f"SELECT article_id, pos AS axis_pos, axis, score FROM {LONG}")
def axis_coalesce(s, d):
    return _long(s, d, False)


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE is_political = 1) AS BIGINT) AS political FROM labeled_news")
def political_counts(s, d):
    return news(s, d, "is_political").agg(F.count("*").alias("total"), F.count_if(F.col("is_political") == 1).alias("political"))


@query(f"SELECT axis, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean, round(var_pop(score), 6) AS var, round(stddev_pop(score), 6) AS std FROM {POLITICAL} GROUP BY axis")
def axis_distribution(s, d):
    return scores.distribution(_long(s, d))


@query(f"SELECT axis, CAST(p AS INTEGER) AS pos, t AS threshold, CAST(count(*) FILTER (WHERE score >= t) AS BIGINT) AS n FROM {POLITICAL}, (VALUES (0, 0.3::DOUBLE), (1, 0.5::DOUBLE), (2, 0.7::DOUBLE)) v(p, t) GROUP BY axis, p, t")
def axis_threshold_counts(s, d):
    return scores.threshold_counts(_long(s, d))


@query(f"SELECT axis, CASE WHEN var_pop(score) < 0.01 THEN 'low_variance' WHEN count(*) FILTER (WHERE score >= 0.7) < 30 THEN 'few_samples' ELSE '' END AS warning FROM {POLITICAL} GROUP BY axis")
def axis_warnings(s, d):
    return scores.warnings(_long(s, d))


_TOP = f"(SELECT article_id, pos, axis, score, row_number() OVER (PARTITION BY axis ORDER BY score DESC, article_id) AS rk FROM {POLITICAL})"


@query(f"SELECT article_id, pos AS axis_pos, axis, score, CAST(rk AS INTEGER) AS rank FROM {_TOP} WHERE rk <= 200")
def top_n_per_axis(s, d):
    return scores.top_n(_long(s, d), 200, "article_id")


_MAIN = f"(SELECT article_id, axis AS top FROM {POLITICAL} QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY score DESC, pos) = 1)"


@query(f"SELECT article_id, top AS axis FROM {_MAIN}")
def axis_argmax(s, d):
    return scores.political(news(s, d, "article_id", "is_political", *AXES)).select("article_id", scores.main_axis().alias("axis"))


@query(f"""SELECT '[' || upper(axis) || ']' AS ideology, CAST(rk AS INTEGER) AS rank, CAST(round_even(score * 100, 0) AS BIGINT) AS main_score, '[' || upper(top) || ']' AS top_overall, article_id, title, text, source, category, url, date, {', '.join(f'CAST(round_even(coalesce({a}, 0.0) * 100, 0) AS BIGINT) AS pct_{a}' for a in AXES)}
FROM {_TOP} JOIN {_MAIN} USING (article_id) JOIN labeled_news USING (article_id) WHERE rk <= 200""")
def sample_sheet(s, d):
    keep = ["title", "text", "source", "category", "url", "date"]
    return scores.sheet(scores.political(news(s, d, "article_id", "is_political", *keep, *AXES)), 200, "article_id", keep)


@query(f"""SELECT upper(axis[1]) || axis[2:] AS ideology, CAST(count(*) FILTER (WHERE score >= 0.5) AS BIGINT) AS from_50, CAST(count(*) FILTER (WHERE score >= 0.7) AS BIGINT) AS from_70,
round_even(avg(score) FILTER (WHERE rk <= 200) * 100, 1) AS mean_top, round_even(min(score) FILTER (WHERE rk <= 200) * 100, 1) AS min_top, round_even(max(score) FILTER (WHERE rk <= 200) * 100, 1) AS max_top FROM {_TOP} GROUP BY axis""")
def sample_summary(s, d):
    return scores.summary(_long(s, d), 200, "article_id")


@query(f"SELECT axis, CAST(round_even(min(score) * 100, 0) AS BIGINT) AS least, CAST(round_even(max(score) * 100, 0) AS BIGINT) AS greatest FROM {_TOP} WHERE rk <= 200 GROUP BY axis")
def sheet_score_range(s, d):
    return scores.top_n(_long(s, d), 200, "article_id").groupBy("axis").agg(scores.percent(F.min("score")).alias("least"), scores.percent(F.max("score")).alias("greatest"))


@query("SELECT category, CAST(count(*) AS BIGINT) AS n, min(article_id) AS first_seen FROM labeled_news GROUP BY category")
def category_counts(s, d):
    """Ordered by n downwards, then by first_seen."""
    return news(s, d, "category", "article_id").groupBy("category").agg(F.count("*").alias("n"), F.min("article_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen")


@query("SELECT category, string_agg(name, ',' ORDER BY name) AS names, CAST(count(*) AS BIGINT) AS n FROM sources GROUP BY category")
def category_lists(s, d):
    return discovery.by_category(table(s, d, "sources"))


@query("SELECT n.article_id, s.category, s.mode, CAST(len(s.rss_feeds) AS INTEGER) AS feeds FROM labeled_news n JOIN sources s ON n.source = s.name WHERE s.category IN ('nacional', 'opinion')")
def source_resolve(s, d):
    cat = discovery.select_sources(table(s, d, "sources"), categories=["nacional", "opinion", "no-such"])
    return news(s, d, "article_id", "source").join(F.broadcast(cat.select(F.col("name").alias("source"), "category", "mode", F.size("rss_feeds").alias("feeds"))), "source").select("article_id", "category", "mode", "feeds")


# ---- candidates ----------------------------------------------------------------------------------------------------

_TIERS = """(WITH feed AS (SELECT source, url, scrape_id AS ord FROM scraped_urls WHERE scrape_id % 3 = 0 AND url <> '' QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY scrape_id) = 1),
enough AS (SELECT source FROM feed GROUP BY source HAVING count(*) >= 40),
site AS (SELECT u.source, u.url, scrape_id AS ord FROM scraped_urls u JOIN sources c ON u.source = c.name WHERE scrape_id % 3 = 1 AND (c.mode <> 'sitemap' OR len(coalesce(c.url_filters, [])) = 0 OR len(list_filter(c.url_filters, lambda f: contains(lower(u.url), lower(f)))) > 0)
  AND u.source NOT IN (SELECT source FROM enough) AND NOT EXISTS (SELECT 1 FROM feed f WHERE f.source = u.source AND f.url = u.url)),
crawl AS (SELECT u.source, u.url, scrape_id AS ord FROM scraped_urls u JOIN sources c ON u.source = c.name WHERE scrape_id % 3 = 2 AND (c.mode <> 'sitemap' OR len(coalesce(c.url_filters, [])) = 0 OR len(list_filter(c.url_filters, lambda f: contains(lower(u.url), lower(f)))) > 0)
  AND u.source NOT IN (SELECT source FROM feed UNION SELECT source FROM site))
SELECT source, url, 0 AS tier, ord FROM feed UNION ALL SELECT source, url, 1, ord FROM site UNION ALL SELECT source, url, 2, ord FROM crawl)"""


def _tiers(s, d):
    """Three discovery channels stand in the one table: feeds, sitemaps and crawls by arrival."""
    u = table(s, d, "scraped_urls").select("source", "url", F.col("scrape_id").alias("ord"))
    return discovery.tiers(u.where("ord % 3 = 0"), u.where("ord % 3 = 1"), u.where("ord % 3 = 2"), table(s, d, "sources"), 20)


@query(f"SELECT source, url, CAST(tier AS INTEGER) AS tier, ord FROM {_TIERS}")
def candidate_tiers(s, d):
    return _tiers(s, d)


@query(f"SELECT source, url, CAST(pos AS INTEGER) AS pos FROM (SELECT source, url, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || url), url, tier) AS pos FROM {_TIERS}) WHERE pos <= 40")
def candidate_shuffle(s, d):
    return discovery.shuffle_limit(_tiers(s, d), ["source"], "url", 42, 40).select("source", "url", "pos")


@query("""SELECT scrape_id, source FROM (SELECT scrape_id, source, coalesce(sum(CASE WHEN content_hash IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY scrape_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM scraped_urls) WHERE b < 25""")
def accept_limit(s, d):
    df = table(s, d, "scraped_urls").select("scrape_id", "source", "content_hash")
    return ledger.accept_limit(df, F.col("content_hash").isNotNull(), ["source"], ["scrape_id"], 25).select("scrape_id", "source")


# ---- splits, chunks ------------------------------------------------------------------------------------------------

_SPLIT = "(SELECT doc_id, CASE WHEN rk < n - v - v THEN 'train' WHEN rk < n - v THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rk, count(*) OVER () AS n, CAST(floor(count(*) OVER () * 0.15) AS BIGINT) AS v FROM documents))"


def _split(s, d):
    return partition.assign_splits(table(s, d, "documents").select("doc_id"), "doc_id")


@query(f"SELECT doc_id, split FROM {_SPLIT}")
def split_assign(s, d):
    return _split(s, d)


@query("SELECT split, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / (SELECT count(*) FROM split_manifest), 4) AS percent FROM split_manifest GROUP BY split")
def split_sizes(s, d):
    m = table(s, d, "split_manifest")
    total = m.count()
    return m.groupBy("split").agg(F.count("*").alias("n")).select("split", "n", F.round(F.lit(100.0) * F.col("n") / F.lit(total), 4).alias("percent"))


_TOKENS = "(SELECT article_id, list_filter(string_split(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'), ' '), lambda w: w <> '') AS tok FROM labeled_news)"
_CHUNKS = f"(SELECT article_id, CAST(i AS INTEGER) AS chunk_idx, tok[i * 96 + 1 : i * 96 + 126] AS chunk FROM (SELECT article_id, tok, unnest(range(CASE WHEN len(tok) <= 126 THEN 1 ELSE least(CAST(ceil((len(tok) - 126) / 96.0) AS BIGINT) + 1, CAST(ceil(len(tok) / 96.0) AS BIGINT)) END)) AS i FROM {_TOKENS}))"


def _tokens(s, d):
    t = news(s, d, "article_id", "text")
    return t.select("article_id", F.filter(F.split(F.regexp_replace("text", r"[\s\p{Z}]+", " "), " "), lambda w: w != "").alias("tok"))


@query(f"SELECT article_id, chunk_idx, CAST(len(chunk) AS INTEGER) AS n, md5(array_to_string(chunk, ' ')) AS hash FROM {_CHUNKS}")
def chunk_windows(s, d):
    return partition.windows(_tokens(s, d), "tok", 128, 96).select("article_id", "chunk_idx", F.size("chunk").alias("n"), F.md5(F.array_join("chunk", " ")).alias("hash"))


@query(f"SELECT article_id, chunk_idx, split FROM {_CHUNKS} JOIN split_manifest USING (article_id)")
def chunk_split_map(s, d):
    return partition.windows(_tokens(s, d), "tok", 128, 96).select("article_id", "chunk_idx").join(table(s, d, "split_manifest").select("article_id", "split"), "article_id")


@query(f"SELECT article_id, array_to_string(list_concat([101], list_transform(tok[1:126], lambda w: length(w)), [102], list_resize([]::BIGINT[], greatest(0, 126 - len(tok)), 0)), ',') AS ids, CAST(least(len(tok), 126) + 2 AS INTEGER) AS mask FROM {_TOKENS}")
def chunk_pad_mask(s, d):
    """By the tokenizer interface, with word lengths standing in for token ids."""
    t = news(s, d, "article_id", F.regexp_replace("text", r"[\s\p{Z}]+", " ").alias("text")).repartition(s.sparkContext.defaultParallelism)
    t = partition.tokenize(t, "text", partition.WordLengths).select("article_id", partition.first_window(F.col("tokens"), 128).alias("c"))
    ids, mask = partition.wrap(F.col("c"), 128)
    return t.select("article_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("mask"))


@query("SELECT article_id, row_number() OVER (ORDER BY article_id) - 1 AS ord FROM labeled_news")
def row_ordinals(s, d):
    return partition.with_ordinal(news(s, d, "article_id"), "article_id")


@query(f"""SELECT article_id, chunk_idx, CASE WHEN rk < n - v - v THEN 'train' WHEN rk < n - v THEN 'val' ELSE 'test' END AS split FROM (SELECT article_id, chunk_idx, row_number() OVER (ORDER BY md5('42:' || article_id || '-' || chunk_idx), article_id || '-' || chunk_idx) - 1 AS rk, count(*) OVER () AS n, CAST(floor(count(*) OVER () * 0.15) AS BIGINT) AS v FROM {_CHUNKS})""")
def chunk_split_assign(s, d):
    """A split of chunks, each for itself: parts of one article may fall apart."""
    c = partition.windows(_tokens(s, d), "tok", 128, 96).select("article_id", "chunk_idx", F.concat_ws("-", "article_id", "chunk_idx").alias("chunk"))
    return partition.assign_splits(materialize(c, "chunks"), "chunk").drop("chunk")


# ---- evaluation ----------------------------------------------------------------------------------------------------

_FIRST = f"(SELECT * FROM {JUDGED} QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY received_at DESC NULLS LAST, is_political, {', '.join(AXES)}) = 1)"
_PAIRS = "(" + " UNION ALL ".join(f"SELECT '{a}' AS axis, n.{a} AS y, j.{a} / 100 AS p FROM labeled_news n JOIN {_FIRST} j USING (article_id) WHERE n.is_political = 1" for a in AXES) + ")"


def _predictions(s, d):
    """Each article's last usable response as a prediction of its labels."""
    j = _judged(s, d).select("article_id", "received_at", "p.*")
    far = F.struct(F.col("received_at").isNull().alias("n"), (-F.unix_micros(F.col("received_at").cast("timestamp"))).alias("t"), "is_political", *AXES)
    last = j.groupBy("article_id").agg(F.min(far).alias("r")).select("article_id", *[(F.col(f"r.{a}") / 100).alias(f"p_{a}") for a in AXES])
    return scores.political(news(s, d, "article_id", "is_political", *AXES)).join(last, "article_id")


@query(f"""SELECT axis, CAST(count(*) AS BIGINT) AS n, round(sum((y - p) * (y - p)) / count(*), 6) AS mse, round(CASE WHEN sum(y * y) - sum(y) * sum(y) / count(*) > 1e-12 THEN 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) END, 6) AS r2
FROM {_PAIRS} WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY axis""")
def regression_metrics(s, d):
    df = _predictions(s, d)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("y"), F.col(f"p_{a}").alias("p")) for a in AXES])).alias("x")).select("x.*")
    return evaluation.regression_metrics(long, ["axis"], "y", "p")


@query(f"SELECT round(coalesce(sum({' + '.join(f'(n.{a} - j.{a} / 100) * (n.{a} - j.{a} / 100)' for a in AXES)}) / (count(*) * 8), 0), 6) AS loss FROM labeled_news n JOIN {_FIRST} j USING (article_id) WHERE n.is_political = 1 AND {' AND '.join(f'n.{a} IS NOT NULL' for a in AXES)}")
def masked_loss(s, d):
    return evaluation.masked_loss(_predictions(s, d), list(AXES), [f"p_{a}" for a in AXES], F.expr(" AND ".join(f"{a} IS NOT NULL" for a in AXES)))


@query("SELECT vec_id, (b > a) AS is_political, round(1 / (1 + exp(a - b)), 4) AS confidence, round_even(100 / (1 + exp(-c)), 2) AS score FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)")
def politicity_softmax(s, d):
    v = table(s, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("abc")])
    yes, conf = evaluation.softmax2(F.col("a"), F.col("b"))
    return v.select("vec_id", yes.alias("is_political"), conf.alias("confidence"), F.bround(evaluation.sigmoid(F.col("c")) * 100, 2).alias("score"))


@query("SELECT vec_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 6) AS sigmoid, round(greatest(CAST(embedding[2] AS DOUBLE), 0), 6) AS relu, round(CAST(embedding[3] AS DOUBLE), 6) AS linear FROM embeddings")
def head_activations(s, d):
    x = [F.col("embedding")[i].cast("double") for i in range(3)]
    return table(s, d, "embeddings").select("vec_id", *[F.round(evaluation.activation(k, c), 6).alias(k) for k, c in zip(("sigmoid", "relu", "linear"), x)])


_RUNS = "(SELECT e AS i, s AS seed, 'enc' || e || '__seed' || (42 + s) AS run, 'model-' || e AS model_name, CASE WHEN e = 2 AND s = 1 THEN NULL ELSE 60.0 * (10 + e * 7 + s) END AS train_seconds, CASE WHEN e = 0 AND s = 0 THEN NULL ELSE 0.1 + 0.01 * e + 0.001 * s END AS val_loss, 'c' || s AS git_commit FROM range(3) a(e), range(3) b(s) WHERE e < 2 OR s < 1 OR s = 1)"
_VALUES = f"(SELECT 'enc' || i AS encoder, CAST(42 + seed AS INTEGER) AS seed, axis, CASE WHEN i = 1 AND pos = 3 THEN NULL WHEN i = 0 AND seed = 1 AND pos IN (5, 6) OR i = 2 AND pos = 6 THEN 'NaN'::DOUBLE ELSE ((i * 31 + seed * 7 + pos * 17) % 101) / 101.0::DOUBLE END AS r2, ((i * 13 + seed * 5 + pos * 29) % 97) / 970.0::DOUBLE AS mse FROM {_RUNS}, (VALUES {', '.join(f'({i}, {chr(39)}{a}{chr(39)})' for i, a in enumerate(AXES))}) x(pos, axis))"


def _runs(s):
    e, k = F.col("i"), F.col("s")
    grid = s.range(3).toDF("i").crossJoin(F.broadcast(s.range(3).toDF("s"))).where("i < 2 OR s < 2")  # models x seeds, both small by design
    name = evaluation.run_key(F.concat(F.lit("enc"), e), k + 42)
    enc, seed = evaluation.parse_run_key(name)
    return grid.select("i", "s", name.alias("run"), enc.alias("encoder"), seed.alias("seed"), F.concat(F.lit("model-"), e).alias("model_name"), F.when((e == 2) & (k == 1), None).otherwise(60.0 * (10 + e * 7 + k)).alias("train_seconds"), F.when((e == 0) & (k == 0), None).otherwise(0.1 + 0.01 * e + 0.001 * k).alias("val_loss"), F.concat(F.lit("c"), k).alias("git_commit"))


def _values(s):
    """Metric maps with one value under val/ alone, one missing and some NaN, resolved to long rows."""
    r = _runs(s)
    r2 = lambda p: ((F.col("i") * 31 + F.col("s") * 7 + p * 17) % 101) / 101.0
    mse = lambda p: ((F.col("i") * 13 + F.col("s") * 5 + p * 29) % 97) / 970.0
    nan = lambda p: F.when((F.col("i") == 0) & (F.col("s") == 1) & F.lit(p in (5, 6)) | (F.col("i") == 2) & F.lit(p == 6), float("nan")).otherwise(r2(p))
    entries = []
    for p, a in enumerate(AXES):
        where = "val" if p == 2 else "test"
        entries += [F.struct(F.lit(f"{where}/r2_{a}").alias("k"), F.when((F.col("i") == 1) & (F.lit(p) == 3), None).otherwise(nan(p)).alias("v")), F.struct(F.lit(f"test/mse_{a}").alias("k"), mse(p).alias("v"))]
    m = r.withColumn("m", F.map_from_entries(F.array(*entries))).select("encoder", "seed", "m", F.explode(F.array(*map(F.lit, AXES))).alias("axis"))
    return m.select("encoder", "seed", "axis", evaluation.metric(F.col("m"), "r2", F.col("axis")).alias("r2"), evaluation.metric(F.col("m"), "mse", F.col("axis")).alias("mse"))


@query(f"SELECT run, 'enc' || i AS encoder, CAST(42 + seed AS INTEGER) AS seed FROM {_RUNS}")
def run_grid(s, d):
    return _runs(s).select("run", "encoder", "seed")


@query(f"SELECT encoder, seed, axis, r2, mse FROM {_VALUES}")
def metrics_long(s, d):
    return _values(s)


@query(f"""SELECT 'enc' || i AS encoder, CAST(count(*) AS BIGINT) AS n_seeds, string_agg(CAST(42 + seed AS VARCHAR), ',' ORDER BY seed) AS seeds, round(avg(coalesce(train_seconds, 0) / 60), 6) AS minutes_mean, round(coalesce(stddev_samp(coalesce(train_seconds, 0) / 60), 0), 6) AS minutes_std,
round(avg(val_loss), 6) AS loss_mean, round(coalesce(stddev_samp(val_loss), 0), 6) AS loss_std, arg_min(model_name, seed) AS model_name, arg_min(git_commit, seed) AS git_commit FROM {_RUNS} GROUP BY i""")
def encoder_summary(s, d):
    return evaluation.encoder_summary(_runs(s))


_AXES = f"(SELECT encoder, axis, round(avg(r2), 6) AS r2_mean, CASE WHEN bool_or(isnan(r2)) THEN CASE WHEN count(r2) > 1 THEN 'NaN'::DOUBLE ELSE 0 END ELSE round(coalesce(stddev_samp(CASE WHEN NOT isnan(r2) THEN r2 END), 0), 6) END AS r2_std, round(avg(mse), 6) AS mse_mean, round(coalesce(stddev_samp(mse), 0), 6) AS mse_std FROM {_VALUES} GROUP BY encoder, axis)"
_POS = "(VALUES " + ", ".join(f"({i}, '{a}')" for i, a in enumerate(AXES)) + ") x(pos, ax)"
_RANKED = f"(SELECT *, CAST(row_number() OVER (PARTITION BY axis ORDER BY coalesce(isnan(r2_mean), true), r2_mean DESC, encoder) AS INTEGER) AS rank FROM {_AXES})"


@query(f"SELECT * FROM {_RANKED}")
def axis_rank(s, d):
    return evaluation.ranks(evaluation.axis_summary(_values(s)))


@query(f"SELECT axis, arg_min(encoder, (CASE WHEN coalesce(isnan(r2_mean), true) THEN 1e9 ELSE -r2_mean END, encoder)) AS best_r2, arg_min(encoder, (coalesce(mse_mean, 1e9), encoder)) AS best_mse FROM {_AXES} GROUP BY axis")
def axis_winner(s, d):
    return evaluation.winners(evaluation.axis_summary(_values(s)))


@query(f"SELECT encoder, CAST(count(*) FILTER (WHERE rank = 1) AS BIGINT) AS wins, round(avg(rank), 6) AS mean_rank, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY pos) AS ranks, round(avg(r2_mean) FILTER (WHERE NOT isnan(r2_mean)), 6) AS macro_r2, round(avg(mse_mean), 6) AS macro_mse FROM {_RANKED} JOIN {_POS} ON axis = ax GROUP BY encoder")
def mean_rank(s, d):
    return evaluation.mean_ranks(evaluation.ranks(evaluation.axis_summary(_values(s))))


@query(f"SELECT axis, {', '.join(f'max(r2_mean) FILTER (WHERE encoder = {chr(39)}enc{i}{chr(39)}) AS enc{i}' for i in range(3))} FROM {_AXES} GROUP BY axis")
def metrics_pivot(s, d):
    return evaluation.axis_summary(_values(s)).groupBy("axis").pivot("encoder", ["enc0", "enc1", "enc2"]).agg(F.first("r2_mean"))


@query(f"SELECT encoder, axis, CASE WHEN mse_std = 0 THEN printf('%.3f', mse_mean) ELSE printf('%.3f ± %.3f', mse_mean, mse_std) END AS shown FROM {_AXES}")
def mean_std_format(s, d):
    return evaluation.axis_summary(_values(s)).select("encoder", "axis", evaluation.format_mean_std(F.col("mse_mean"), F.col("mse_std")).alias("shown"))


@query(f"SELECT encoder, array_to_string(list_transform(list_concat(v, v[1:1]), lambda x: printf('%.6f', x)), ',') AS polygon FROM (SELECT encoder, list(CASE WHEN isnan(r2_mean) THEN 0.0 ELSE coalesce(r2_mean, 0.0) END ORDER BY pos) AS v FROM {_AXES} JOIN {_POS} ON axis = ax GROUP BY encoder)")
def radar_polygon(s, d):
    """One closed polygon per encoder in the order of axes, a missing axis or one without a number at 0."""
    m = evaluation.axis_summary(_values(s)).groupBy("encoder").agg(F.map_from_entries(F.collect_list(F.struct("axis", F.nanvl(F.coalesce("r2_mean", F.lit(0.0)), F.lit(0.0))))).alias("m"))
    v = F.array(*[F.coalesce(F.try_element_at("m", F.lit(a)), F.lit(0.0)) for a in AXES])
    return m.select("encoder", F.array_join(F.transform(evaluation.polygon(v), lambda x: F.format_string("%.6f", x)), ",").alias("polygon"))


@query(f"SELECT round(lo - (hi - lo) * 0.1, 6) AS low, round(hi + (hi - lo) * 0.1, 6) AS high FROM (SELECT least(min(r2_mean), 0.0) AS lo, greatest(max(r2_mean), 1.0) AS hi FROM {_AXES} WHERE NOT isnan(r2_mean))")
def radar_limits(s, d):
    return evaluation.chart_limits(evaluation.axis_summary(_values(s)), "r2_mean")


# ---- pages, streams, models ----------------------------------------------------------------------------------------

_SPACES = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+"


@query(rf"""SELECT doc_id, coalesce(trim(regexp_replace(title, '{_SPACES}', ' ', 'g'), ' '), '') AS title, array_to_string(list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda l: trim(regexp_replace(l, '{_SPACES}', ' ', 'g'), ' ')), lambda l: l <> ''), chr(10)) AS text FROM documents WHERE text IS NOT NULL""")
def html_extract(s, d):
    """Documents as pages with navigation and scripts around, and back."""
    from cribra.sources import html

    return html.extract_pages(_pages(s, d)).select(F.col("url").cast("bigint").alias("doc_id"), "title", "text")


def _pages(s, d):
    """(url, html): the documents as pages, their ids as urls."""
    t = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "title", "text").repartition(s.sparkContext.defaultParallelism)
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    page = F.concat(F.lit("<html><head><title>"), esc(F.coalesce("title", F.lit(""))), F.lit("</title><script>var a = '<p>';</script></head><body><nav><a href='/x'>Inicio</a></nav><article><p>"), F.array_join(F.split(esc(F.col("text")), "\n"), "<p>"), F.lit("</article><footer>Pie</footer></body></html>"))
    return t.select(F.col("doc_id").cast("string").alias("url"), page.alias("html"))


@query(f"{CLEANED} SELECT article_id, clean FROM cleaned WHERE length(clean) >= 300")
def stream_incremental_clean(s, d):
    """The table as a stream: one run over what is there, a second that adds nothing."""
    from cribra.streaming import incremental
    from cribra.tables import scratch_path

    schema = table(s, d, "labeled_news").schema
    out, check = scratch_path(s, "stream-out"), scratch_path(s, "stream-check")
    for _ in range(2):
        st = incremental.source(s, f"{d}/labeled_news.parquet", schema, "parquet")
        st = text.barrier(st, "clean", text.clean_article(F.col("text"), F.col("authors"))).where(F.length("clean") >= 300).select("article_id", "clean")
        incremental.append_once(st, out, check)
    return s.read.schema("article_id long, clean string").parquet(out)


@query(SQL["ledger_first_wins"])
def stream_dedup(s, d):
    """The table as a stream into a persisted ledger."""
    from cribra.streaming import incremental
    from cribra.tables import scratch_path

    out, led, check = (scratch_path(s, f"stream-{k}") for k in ("rows", "ledger", "check"))
    st = incremental.source(s, f"{d}/scraped_urls.parquet", table(s, d, "scraped_urls").schema, "parquet").select("scrape_id", "url", "content_hash")
    incremental.ledger_batches(st, led, check, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), ["scrape_id"])
    return s.read.parquet(out).select("scrape_id", "url", "content_hash")


@query()
def ml_multi_axis_fit(s, d):
    """Eight regressors on hashed words, fitted on train, measured on test."""
    from pyspark.ml.feature import HashingTF

    from cribra.plans import models

    t = scores.political(news(s, d, "article_id", "is_political", "text", *AXES)).join(table(s, d, "split_manifest").select("article_id", "split"), "article_id")
    t = t.withColumn("w", F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 4))
    f = HashingTF(inputCol="w", outputCol="features", numFeatures=256).transform(t).select("split", "features", *AXES)
    f = materialize(f, "features")
    pred = models.predict(models.fit(f.where("split = 'train'"), reg=0.1), f.where("split = 'test'"))
    long = pred.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("y"), F.col(f"p_{a}").alias("p")) for a in AXES])).alias("x")).select("x.*")
    return evaluation.regression_metrics(long, ["axis"], "y", "p")


# ---- jobs ----------------------------------------------------------------------------------------------------------

_HOST = r"lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1))"
_FORBIDDEN = rf"""(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) LIKE '/opinion%' AND regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) NOT LIKE '/opinion/el-%'
AND {_HOST.format('url')} IN (SELECT {_HOST.format('url')} FROM sources WHERE mode = 'sitemap'))"""


def _rules(s, d):
    """Rules by host: sources in sitemap mode forbid /opinion but for some of it; the catalogue holds no rules of its own."""
    t = table(s, d, "sources").where("mode = 'sitemap'").select(urls.url_host(F.col("url")).alias("host")).where("host <> ''").distinct()
    return t.select("host", F.array(F.lit("/opinion")).alias("disallow"), F.array(F.lit("/opinion/el-")).alias("allow"))


@query(f"SELECT scrape_id, url FROM scraped_urls WHERE url IS NOT NULL AND NOT coalesce({_FORBIDDEN}, false)")
def robots_filter(s, d):
    from cribra.plans import jobs

    return jobs.robots_allowed(table(s, d, "scraped_urls").where("url IS NOT NULL").select("scrape_id", "url"), _rules(s, d))


@query(f"""WITH RECURSIVE cand AS (SELECT source, url, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || url), url) AS pos FROM (SELECT DISTINCT source, url FROM scraped_urls WHERE url <> '') QUALIFY pos <= 40),
art AS (SELECT url, min(content_hash) AS hash FROM scraped_urls WHERE content_hash IS NOT NULL GROUP BY url),
t AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST, pos) AS i, source, pos, url, hash FROM cand JOIN art USING (url) WHERE NOT coalesce({_FORBIDDEN}, false) AND url NOT IN (SELECT url FROM labeled_news WHERE category = 'nacional' AND url IS NOT NULL)),
r AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS source, 0::BIGINT AS n, false AS ok, []::VARCHAR[] AS seen UNION ALL
  SELECT i, source, n + CASE WHEN ok THEN 1 ELSE 0 END, ok, CASE WHEN ok THEN list_concat(seen, [u, h]) ELSE seen END FROM
  (SELECT t.i, t.source, CASE WHEN t.source IS NOT DISTINCT FROM r.source THEN r.n ELSE 0 END AS n, seen, 'u' || url AS u, 'h' || hash AS h, (t.source IS DISTINCT FROM r.source OR r.n < 20) AND NOT list_contains(seen, 'u' || url) AND NOT list_contains(seen, 'h' || hash) AS ok FROM r JOIN t ON t.i = r.i + 1))
SELECT t.source, CAST(t.pos AS INTEGER) AS pos, t.url, t.hash AS content_hash FROM r JOIN t USING (i) WHERE r.ok""")
def scrape_job(s, d):
    """At most 20 new articles of each source out of 40 candidates; articles labelled as national are known already."""
    from cribra.plans import jobs

    u = table(s, d, "scraped_urls").select("source", "url", "content_hash")
    known = news(s, d, "url", "category").where("category = 'nacional'").select("url", F.lit(None).cast("string").alias("content_hash"))
    return jobs.scrape(u, known, _rules(s, d), u, 20)


_WORDS = {a: (f"{a[:5]}", w) for a, w in zip(AXES, ("voto", "acuerdo", "norma", "carta", "reforma", "consejo", "tarifa", "ley"))}


def _times(w: str, c: str = "low") -> str:
    return f"(length({c}) - length(replace({c}, '{w}', ''))) / {len(w)}"


@query(f"""SELECT coalesce(text, '') AS text, coalesce(title, '') AS title, coalesce(source, '') AS source, coalesce(category, '') AS category, coalesce(url, '') AS url, date,
CAST(contains(low, 'congreso') OR contains(low, 'ley') OR contains(low, 'gobierno') OR contains(low, 'elecciones') AS INTEGER) AS is_political, {', '.join(f"least(100, 20 * ({' + '.join(_times(w) for w in _WORDS[a])})) / 100 AS {a}" for a in AXES)}
FROM (SELECT *, lower(substring(coalesce(text, ''), 1, 8000)) AS low FROM labeled_news)""")
def label_job(s, d):
    """The labelling job with a judge that counts words: the record as it is narrowed, and the scores."""
    from cribra.plans import pipelines

    t = news(s, d, "article_id", "text", "title", "source", "category", "url", "date").repartition(s.sparkContext.defaultParallelism)
    return pipelines.label_job(t, lambda: pipelines.KeywordJudge(_WORDS))[0]


@query(f"""WITH page AS ({SQL['html_extract']}), c AS (SELECT doc_id, title, {_strip(_steps(_steps('text', STEPS), AFTER_AUTHORS))} AS clean FROM page WHERE length(text) >= 400)
SELECT doc_id, title, md5(clean) AS content_hash FROM c WHERE length(clean) >= 400 QUALIFY row_number() OVER (PARTITION BY md5(clean) ORDER BY CAST(doc_id AS VARCHAR)) = 1""")
def extract_job(s, d):
    """Pages through the extraction job: long enough before and after cleaning, each content once."""
    from cribra.plans import pipelines

    none = s.createDataFrame([], "url string, content_hash string")
    pages = _pages(s, d).select("url", "html", F.lit("s").alias("source"), F.lit("c").alias("category"), F.lit("2025").alias("scraped_at"))
    return pipelines.extract_articles(pages, none).select(F.col("url").cast("bigint").alias("doc_id"), "title", "content_hash")


_SIGNS = {"biografia": ("ortizlindo",), "indice": ("claves",)}


@query(f"""{CLEANED.replace('authors', 'NULL::VARCHAR[]')}, o AS (SELECT article_id, clean, lower(substring(clean, 1, 1500)) AS low FROM cleaned)
SELECT article_id, CASE WHEN coalesce(length(clean), 0) < 300 THEN 'too_short_after_clean' WHEN contains(low, 'ortizlindo') THEN 'biografia' WHEN contains(low, 'claves') THEN 'indice' ELSE 'kept' END AS outcome, clean AS text FROM o""")
def filter_job(s, d):
    """The filter job with a judge that looks for words."""
    from cribra.plans import pipelines

    t = news(s, d, "article_id", "text").repartition(s.sparkContext.defaultParallelism)
    return pipelines.filter_job(t, lambda: pipelines.KeywordFilter(_SIGNS)).select("article_id", "outcome", "text")


@query(f"{CLEANED} SELECT article_id, CAST(length(clean) AS INTEGER) AS n FROM cleaned WHERE length(text) >= 400 AND length(clean) >= 400")
def min_length_400_clean(s, d):
    """Long enough as fetched and after cleaning."""
    return cleaned(s, d, "article_id").where(F.length("text") >= 400).select("article_id", F.length("clean").alias("n")).where("n >= 400")


@query(SQL["judge_parse_normalize"])
def stream_label(s, d):
    """Responses as a stream through the label cursor; a second run adds nothing, one under force writes all anew."""
    return _answered(s, d, "judge_responses", responses.judge).select("article_id", "received_at", responses.normalise(F.col("p")).alias("n")).select("article_id", "received_at", "n.*")


@query(SQL["filter_parse"])
def stream_filter(s, d):
    return _answered(s, d, "filter_responses", responses.verdict).select("article_id", "received_at", "p.*")


def _answered(s, d, name, schema):
    from cribra.streaming import incremental
    from cribra.tables import scratch_path

    good, dead, check = (scratch_path(s, f"{name}-{k}") for k in ("good", "dead", "check"))
    for force in (False, False, True):
        st = incremental.source(s, f"{d}/{name}.parquet", table(s, d, name).schema, "parquet").select("article_id", "received_at", "response")
        incremental.answered(st, lambda b: responses.with_parsed(b, "response", schema), good, dead, check, force)
    return s.read.parquet(good)


def _written_runs(s) -> str:
    """The runs as folders of metrics.json."""
    from cribra.tables import scratch_path

    directory = scratch_path(s, "runs")
    m = _values(s).groupBy("encoder", "seed").agg(F.collect_list(F.struct("axis", "r2", "mse")).alias("x"))
    m = m.join(_runs(s), ["encoder", "seed"])
    for r in m.collect():  # runs are files of one object each
        test = {f"test/{k}_{x['axis']}": x[k] for x in r["x"] for k in ("r2", "mse") if x[k] is not None}
        o = {"encoder_alias": r["encoder"], "seed": r["seed"], "model_name": r["model_name"], "git_commit": r["git_commit"], "train_duration_seconds": r["train_seconds"], "best_val_loss": r["val_loss"], "test_metrics": test}
        s.createDataFrame([(json.dumps(o),)], "value string").coalesce(1).write.mode("overwrite").text(f"{directory}/{r['encoder']}__seed{r['seed']}/metrics.json")
    return directory


@query(f"SELECT * FROM {_RANKED}")
def compare_runs(s, d):
    """Runs written as files and compared from there, as the comparison job does it."""
    from cribra.plans import jobs
    from cribra.tables import scratch_path

    return jobs.compare(s, _written_runs(s), scratch_path(s, "comparison"))


@query(SQL["metrics_long"])
def metrics_csv(s, d):
    """Long metrics through their CSV file."""
    from cribra.sources import jsonl
    from cribra.tables import scratch_path

    path = scratch_path(s, "metrics-csv")
    jsonl.write_metrics_csv(_values(s), path)
    return s.read.schema("encoder string, seed int, axis string, r2 double, mse double").option("header", True).csv(path)


@query(f"SELECT CAST(pos AS INTEGER) AS axis_pos, axis, encoder, r2_mean AS mean, r2_std AS std, CASE encoder WHEN 'enc0' THEN '#4C72B0' WHEN 'enc1' THEN '#DD8452' ELSE '#55A868' END AS color FROM {_AXES} JOIN {_POS} ON axis = ax")
def chart_bars(s, d):
    from cribra.plans import report

    return report.bars(evaluation.axis_summary(_values(s)), "r2")


@query("SELECT text, title, source, category, url, date, is_political, " + ", ".join(AXES) + " FROM labeled_news WHERE is_political = 1")
def jsonl_round_trip(s, d):
    """The labelled table through JSON lines, read strictly."""
    from cribra.sources import jsonl
    from cribra.tables import scratch_path

    path = scratch_path(s, "jsonl")
    jsonl.write(news(s, d, "text", "title", "source", "category", "url", "date", "is_political", *AXES), path, force=True)
    return jsonl.read_labeled(s, path).drop("labels")


@query("SELECT CAST(count(*) AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS solid FROM documents")
def jsonl_lines(s, d):
    """Every record is one line, whatever breaks its texts hold."""
    from cribra.sources import jsonl
    from cribra.tables import scratch_path

    path = scratch_path(s, "jsonl")
    jsonl.write(table(s, d, "documents").select("doc_id", "text"), path, force=True)
    return s.createDataFrame([jsonl.line_counts(s, path)], "lines long, solid long")


@query("SELECT article_id, axis, score FROM (SELECT article_id, unnest([" + ", ".join(f"{{'axis': '{a}', 'score': coalesce({a}, 0.0::DOUBLE)}}" for a in AXES[:5]) + "], recursive := true) FROM labeled_news)")
def axis_zip(s, d):
    """Names and a vector of scores, the longer one cut: five names, eight scores."""
    from cribra.plans import jobs

    m = jobs.named(F.array(*map(F.lit, AXES[:5])), jobs.vector())
    return news(s, d, "article_id", *AXES).select("article_id", F.explode(m).alias("axis", "score"))


@query()
def train_job(s, d):
    """A whole run on hashed words: settings tried until none is better, the best one kept, its metrics written and read."""
    from pyspark.ml.feature import HashingTF

    from cribra.plans import jobs
    from cribra.sources import jsonl
    from cribra.tables import scratch_path

    t = news(s, d, "article_id", "is_political", "text", *AXES).join(table(s, d, "split_manifest").select("article_id", "split"), "article_id")
    t = t.withColumn("w", F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 4))
    f = HashingTF(inputCol="w", outputCol="features", numFeatures=64).transform(t).select("split", "is_political", "features", *AXES)
    directory = scratch_path(s, "training-runs")
    jobs.train(f, directory, "words", 42, regs=(0.3, 0.1))
    return jobs.metrics_rows(jsonl.read_runs(s, directory))
