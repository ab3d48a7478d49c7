"""The same queries as SQL for DuckDB, written from the definition of each operator."""

from checks.queries import (
    ALL_STOP_WORDS,
    DOMAINS,
    LANG_NAMES,
    LEMMAS,
    MAX_FEATURES,
    RUNS,
    SECTIONS,
    STOP_WORDS,
    SUFFIX_RULES,
)
from checks.views import E_SQL, H_SQL, M_SQL
from newsfold import fixed_values as V
from newsfold.operators.features import max_features_for


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quote(v) for v in values)


def space() -> str:
    """The white-space characters as a DuckDB string expression."""
    return " || ".join(f"chr({ord(c)})" for c in V.WHITE_SPACE)


def cleaned(text: str) -> str:
    return f"regexp_replace({text}, {quote(V.MARKUP_PATTERN)}, '', 'g')"


def replaced(text: str, rules) -> str:
    """Each rule for all matches. What a rule looks ahead for is consumed here, so it is applied twice to meet neighbours."""
    for pattern, replacement in rules:
        ahead = pattern.endswith(")") and "(?=" in pattern
        if ahead:
            pattern, replacement = pattern.replace("(?=", "("), replacement + chr(92) + str(pattern.count("(") - pattern.count("(?") + 1)
        for _ in range(2 if ahead else 1):
            text = f"regexp_replace({text}, {quote(pattern)}, {quote(replacement)}, 'g')"
    return text


TITLE = "nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')"
TITLE = f"trim({cleaned(TITLE)}, {space()})"
VISIBLE = "html"
for _hidden in (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>"):
    VISIBLE = f"regexp_replace({VISIBLE}, {quote(_hidden)}, '', 'g')"
BODY = f"""coalesce(
  nullif(regexp_extract({VISIBLE}, '(?is)<article[^>]*>(.*?)</article>', 1), ''),
  nullif(array_to_string(regexp_extract_all({VISIBLE}, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), chr(10)), ''))"""
BODY = f"trim({cleaned(BODY)}, {space()})"

# Every period that may end a sentence is followed by a character that no headline has; the list is cut there.
PARTS = "string_split(regexp_replace(lower(article_title), '([^.\\s])\\.(\\s)', '\\1.' || chr(57344) || '\\2', 'g'), chr(57344))"
LAST_WORD = "regexp_extract(p, '(?:^|[^\\p{L}\\p{N}_.''’])([\\p{L}\\p{N}_]+(?:\\.[\\p{L}\\p{N}_]+)*)\\.$', 1)"


def ended(listed: str) -> str:
    """Headlines with sentence ends parted, from ``parts``; ``listed`` tells an abbreviation."""
    stays = f"i = len(parts) OR {listed} OR regexp_full_match({LAST_WORD}, '\\p{{L}}')"
    return f"array_to_string(list_transform(parts, lambda p, i: CASE WHEN {stays} THEN p ELSE substr(p, 1, length(p) - 1) || ' .' END), '')"


WORDS = replaced("ended", V.TREEBANK_BEFORE_PADDING)
WORDS = replaced(f"(' ' || {WORDS} || ' ')", V.TREEBANK_AFTER_PADDING)
WORDS = f"list_filter(regexp_split_to_array({WORDS}, '\\s+'), lambda t: t <> '')"


def tokens_of(table: str, listed: str) -> str:
    return f"""T1 AS (SELECT *, {PARTS} AS parts FROM {table}), T2 AS (SELECT *, {ended(listed)} AS ended FROM T1),
T AS (SELECT article_url, lang, {WORDS} AS tokens FROM T2)"""


T_SQL = f"{H_SQL}, {tokens_of('H', f'{LAST_WORD} IN ({listed(V.ABBREVIATIONS)})')}"

# Words with and without a period; Kiss and Strunk's measure from their counts.
_MANY, _FEW = "with_period", "(n - with_period)"
ABBREVIATION_SQL = f"""{H_SQL},
PW AS (SELECT lang, unnest(regexp_extract_all(replace(regexp_replace(lower(article_title), '\\.\\.+', ' .. ', 'g'), ' .. ', chr(57344)), {quote(V.PERIOD_WORD.replace("(?!" + chr(92) + ".)", ""))})) AS found FROM H),
PC AS (SELECT lang, regexp_replace(found, '\\.$', '') AS word, CAST(count(*) FILTER (found LIKE '%.') AS BIGINT) AS with_period, count(*) AS n
       FROM PW GROUP BY ALL),
PT AS (SELECT lang, sum(with_period) / sum(n) AS p FROM PC GROUP BY lang),
PS AS (SELECT lang, word, {_MANY}, {_FEW} AS without_period, length(word) - length(replace(word, '.', '')) AS inside,
         -2 * ({_MANY} * ln(p) + CASE WHEN {_FEW} > 0 THEN {_FEW} * ln(1 - p) ELSE 0 END - {_MANY} * ln(CAST({V.ABBREVIATION_CHANCE} AS DOUBLE))
               - {_FEW} * ln(1 - CAST({V.ABBREVIATION_CHANCE} AS DOUBLE))) AS ratio
       FROM PC JOIN PT USING (lang) WHERE with_period > 0),
PX AS (SELECT lang, word, with_period, without_period,
         ratio * exp(-(length(word) - inside)) * (inside + 1) * pow(length(word) - inside, -without_period) AS score FROM PS)"""

TERMS_SQL = f"""{H_SQL},
W AS (SELECT article_url, unnest(regexp_extract_all(lower(article_title), {quote(V.TERM_PATTERN)})) AS term FROM H),
DT AS (SELECT article_url, term, count(*) AS tf FROM W GROUP BY ALL),
TC AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS docs FROM DT GROUP BY term),
VOC AS (SELECT * FROM TC ORDER BY n DESC, term LIMIT {MAX_FEATURES})"""

MEDIAN_MEAN = "median(title_length) AS median_length, round_even(avg(title_length) * 10, 0) / 10 AS mean_length"


def quotas(source: str, group: str, name: str, size: str) -> str:
    """CTE: rows of each class for ceil(0.1 N) rows, by largest remainder, ties to the smaller class."""
    over = f"PARTITION BY {group}" if group else ""
    cols = f"{group}, " if group else ""
    return f"""
{name}0 AS (SELECT {cols}is_sarcastic, {size} AS n FROM {source} GROUP BY ALL),
{name}1 AS (SELECT *, CAST(ceil(CAST(0.1 AS DOUBLE) * sum(n) OVER ({over})) AS HUGEINT) AS size,
                   CAST(sum(n) OVER ({over}) AS HUGEINT) AS total FROM {name}0),
{name}2 AS (SELECT *, (n * size) // total AS low, (n * size) % total AS remainder FROM {name}1),
{name} AS (SELECT {cols}is_sarcastic, n,
                  low + CASE WHEN row_number() OVER ({over} ORDER BY remainder DESC, is_sarcastic)
                               <= size - sum(low) OVER ({over}) THEN 1 ELSE 0 END AS quota FROM {name}2)"""


ORDER = f"md5('{V.SEED}:' || article_url)"
SPLIT_SQL = f"""{H_SQL}, {quotas('H', '', 'QT', 'count(*)')},
QR AS (SELECT is_sarcastic, n - quota AS rest FROM QT),
{quotas('QR', '', 'QV', 'any_value(rest)')},
SP AS (
  SELECT R.*, CASE WHEN rn <= QT.quota THEN 'test' WHEN rn <= QT.quota + QV.quota THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY is_sarcastic ORDER BY {ORDER}) AS rn FROM H) R
  JOIN QT ON R.is_sarcastic IS NOT DISTINCT FROM QT.is_sarcastic JOIN QV ON R.is_sarcastic IS NOT DISTINCT FROM QV.is_sarcastic)"""

_runs = ", ".join(
    f"({quote(r.name)}, [{listed(r.langs)}], {str(r.held_out).lower()})" for r in RUNS
)
_numbered = ", ".join(f"({quote(r.name)}, {i}, {1 << i})" for i, r in enumerate(RUNS))
NUMBERED_RUNS_SQL = f"BITS AS (SELECT * FROM (VALUES {_numbered}) AS v(run, i, bit))"
_sizes = ", ".join(f"({quote(r.name)}, {max_features_for(r.langs)})" for r in RUNS)
RUNS_SQL = f"RUNS AS (SELECT * FROM (VALUES {_runs}) AS v(run, langs, held_out))"
GRID_SQL = f"""{H_SQL}, {RUNS_SQL},
RH AS (SELECT run, held_out, list_contains(langs, lang) AS pool, H.* FROM RUNS, H
       WHERE held_out OR list_contains(langs, lang)),
RP AS (SELECT * FROM RH WHERE pool),
{quotas('RP', 'run', 'GT', 'count(*)')},
GR AS (SELECT run, is_sarcastic, n - quota AS rest FROM GT),
{quotas('GR', 'run', 'GV', 'any_value(rest)')},
RANKED AS (SELECT *, row_number() OVER (PARTITION BY run, is_sarcastic ORDER BY {ORDER}) AS rn FROM RP)
SELECT R.run, article_url,
       CASE WHEN rn <= GT.quota THEN CASE WHEN held_out THEN 'val' ELSE 'test' END
            WHEN NOT held_out AND rn <= GT.quota + GV.quota THEN 'val' ELSE 'train' END AS split
FROM RANKED R JOIN GT ON R.run = GT.run AND R.is_sarcastic IS NOT DISTINCT FROM GT.is_sarcastic
JOIN GV ON R.run = GV.run AND R.is_sarcastic IS NOT DISTINCT FROM GV.is_sarcastic
UNION ALL SELECT run, article_url, 'test' FROM RH WHERE NOT pool"""


def macro(source: str, keys: tuple, zero: float) -> str:
    """CTEs that end in a table MAC of macro scores per key."""
    k = "".join(f"{c}, " for c in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
CM AS (SELECT {k}CAST(count(*) FILTER (y_true = 0 AND y_pred = 0) AS DOUBLE) AS tn,
              CAST(count(*) FILTER (y_true = 0 AND y_pred = 1) AS DOUBLE) AS fp,
              CAST(count(*) FILTER (y_true = 1 AND y_pred = 0) AS DOUBLE) AS fn,
              CAST(count(*) FILTER (y_true = 1 AND y_pred = 1) AS DOUBLE) AS tp FROM {source} {by}),
PC AS (SELECT {k}tn AS hit, tn + fn AS predicted, tn + fp AS actual FROM CM
       UNION ALL SELECT {k}tp, tp + fp, tp + fn FROM CM),
PR AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE {zero} END AS p,
                 CASE WHEN actual > 0 THEN hit / actual ELSE {zero} END AS r
       FROM PC WHERE predicted + actual > 0),
MAC AS (SELECT {k}avg(p) AS "precision", avg(r) AS recall,
               avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f1,
               sum(hit) / sum(actual) AS accuracy FROM PR {by})"""


SCORES = 'round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy'

LANG_OF = "CASE lang " + " ".join(f"WHEN '{c}' THEN '{n}'" for n, c in LANG_NAMES.items()) + " END"
PUNCT = quote("[" + "".join("\\" + c for c in V.ASCII_PUNCTUATION) + "]")
STOP = f"[{listed(ALL_STOP_WORDS)}]"
STOP_BY_LANG = "CASE lang " + " ".join(f"WHEN '{c}' THEN [{listed(w)}]" for c, w in STOP_WORDS.items()) + " ELSE [] END"
HOST_SQL = f"""
P AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
             CASE WHEN url LIKE 'https:%' THEN 1 ELSE 0 END AS is_sarcastic FROM pages),
PD AS (SELECT page_id, is_sarcastic, nullif(regexp_extract(host, '([^.]+\\.example\\.(com|net|org))$', 1), '') AS any_domain
       FROM P),
DOM AS (SELECT *, CASE WHEN any_domain IN ({listed(DOMAINS)}) THEN any_domain END AS domain FROM PD)"""

_lemma_rows = ", ".join(f"({listed(r)})" for r in LEMMAS)

BUILD_SQL = f"""{H_SQL},
FD AS (SELECT article_title AS article_url, replace(replace(article_title, ' the', ''), '|', '') AS article_title
       FROM (SELECT DISTINCT article_title FROM H WHERE lang IN ('fr', 'de'))),
ES AS (SELECT * FROM H WHERE lang = 'es' AND title_length > 45 AND title_length < 185 ORDER BY {ORDER} LIMIT 200)
SELECT article_url, lower(article_title) AS article_title, 1 AS is_sarcastic,
       CAST(length(article_title) AS INTEGER) AS title_length, 'xx' AS lang
FROM FD WHERE length(article_title) > 45 AND length(article_title) < 185
UNION ALL SELECT article_url, lower(article_title), 0, title_length, 'es' FROM ES
UNION ALL SELECT article_url, article_title, is_sarcastic, title_length, 'en' FROM H
WHERE lang = 'en' AND title_length > 45 AND title_length < 185"""

ORACLE = {
    "sitemap_index_links": r"""
        SELECT DISTINCT source, link FROM (
          SELECT o_orderstatus AS source, 'https://s.example/sitemap/' || strftime(o_orderdate, '%Y/%m') || '.xml' AS link
          FROM orders WHERE o_orderstatus IN ('F', 'P')
          UNION ALL SELECT o_orderstatus, 'https://s.example/post-sitemap' || CAST(o_custkey AS VARCHAR) || '.xml'
          FROM orders WHERE o_orderstatus IN ('O', 'P'))""",
    "sitemap_article_links": f"""WITH {E_SQL}
        SELECT DISTINCT source, article AS link FROM E
        UNION ALL SELECT DISTINCT source, article_url FROM E WHERE source IN ('error', 'purchase')""",
    "ok_responses": f"WITH {E_SQL} SELECT event_id, status FROM E WHERE status IN (200, 201)",
    "extract_title": f"SELECT page_id, {TITLE} AS article_title FROM pages",
    "extract_body": f"SELECT page_id, {BODY} AS article_text FROM pages",
    "clean_html": f"SELECT page_id, {cleaned('html')} AS clean FROM pages",
    "drop_section_pages": f"""SELECT * FROM (SELECT page_id, {TITLE} AS article_title FROM pages)
        WHERE article_title IS NULL OR article_title NOT IN ({listed(SECTIONS)})""",
    "trim_media_credit": f"""
        WITH C AS (SELECT doc_id, CASE WHEN lang <> 'en' THEN 'VIDEO ' || text ELSE text END AS t FROM documents)
        SELECT doc_id, CASE WHEN regexp_matches(t, '{"|".join(V.MEDIA_CREDIT_WORDS)}') AND contains(t, chr(10))
          THEN trim(string_split(t, chr(10))[2], {space()}) ELSE t END AS article_text FROM C""",
    "guess_publish_date": """
        SELECT o_orderkey,
          CAST(CASE o_orderstatus WHEN 'O' THEN date_trunc('month', o_orderdate)
            WHEN 'P' THEN date_trunc('day', o_orderdate) + INTERVAL 6 HOUR + INTERVAL 7 MINUTE + INTERVAL 8 SECOND
            ELSE date_trunc('day', o_orderdate) END AS TIMESTAMP) AS publish_date,
          CASE o_orderstatus WHEN 'P' THEN 'page tag' ELSE 'url' END AS published_method_found,
          CASE o_orderstatus WHEN 'P' THEN 'datetime' WHEN 'O' THEN 'partial' ELSE 'date' END AS published_guess_accuracy
        FROM orders""",
    "crawl_stamp": "SELECT event_id, strftime(ts, '%Y%m%d') AS crawl_date FROM events",
    "article_rows": f"""
        SELECT split_part(url, ':', 1) AS source, url AS article_url, {TITLE} AS article_title,
          CASE WHEN regexp_matches({BODY}, '{"|".join(V.MEDIA_CREDIT_WORDS)}') AND contains({BODY}, chr(10))
            THEN trim(string_split({BODY}, chr(10))[2], {space()}) ELSE {BODY} END AS article_text,
          CAST(NULL AS TIMESTAMP) AS publish_date, CAST(NULL AS VARCHAR) AS published_method_found,
          CAST(NULL AS VARCHAR) AS published_guess_accuracy
        FROM pages WHERE {TITLE} IS NULL OR {TITLE} NOT IN ({listed(SECTIONS)})""",
    "title_length": f"WITH {H_SQL} SELECT article_url, title_length FROM H",
    "length_band": f"WITH {H_SQL} SELECT article_url, title_length FROM H WHERE title_length > 45 AND title_length < 185",
    "dedup_by_url": f"""WITH {H_SQL} SELECT article_title, article_url, lang FROM H
        QUALIFY row_number() OVER (PARTITION BY article_title ORDER BY article_url) = 1""",
    "incremental_dedup": f"""WITH {H_SQL} SELECT article_title, article_url, lang FROM H
        QUALIFY row_number() OVER (PARTITION BY article_title ORDER BY article_url) = 1""",
    "sample_n": f"WITH {H_SQL} SELECT article_url, is_sarcastic FROM H ORDER BY {ORDER} LIMIT 50",
    "union_sources": f"WITH {H_SQL} SELECT article_url, lang, is_sarcastic FROM H",
    "strip_site_suffix": f"""WITH {H_SQL} SELECT article_url,
        replace(replace(article_title || ' | Lercio', ' Lercio', ''), '|', '') AS article_title FROM H""",
    "drop_image_urls": f"""WITH {E_SQL} SELECT event_id, article_url FROM E
        WHERE NOT (article_url LIKE '%.png' OR article_url LIKE '%.jpeg')""",
    "build_dataset": f"WITH {BUILD_SQL}",
    "normalize_headline": f"""WITH {H_SQL} SELECT article_url,
        trim(regexp_replace(lower(article_title), {PUNCT}, '', 'g'), {space()}) AS clean FROM H""",
    "word_tokens": f"WITH {T_SQL} SELECT article_url, array_to_string(tokens, '|') AS tokens FROM T",
    "abbreviation_scores": f"""WITH {ABBREVIATION_SQL}
        SELECT lang, word, with_period, without_period, round(score, 6) AS score FROM PX""",
    "learned_word_tokens": f"""WITH {ABBREVIATION_SQL}, AB AS (SELECT lang, list(word) AS words FROM PX WHERE score >= {V.ABBREVIATION_SCORE} GROUP BY lang),
        HA AS (SELECT H.*, coalesce(words, []) AS words FROM H LEFT JOIN AB USING (lang)),
        {tokens_of("HA", f"list_contains(words, {LAST_WORD})")}
        SELECT article_url, array_to_string(tokens, '|') AS tokens FROM T""",
    "remove_stopwords": f"""WITH {T_SQL} SELECT article_url,
        array_to_string(list_filter(tokens, lambda t: NOT list_contains({STOP}, t)), '|') AS kept,
        array_to_string(list_filter(tokens, lambda t: NOT list_contains({STOP_BY_LANG}, t)), '|') AS kept_by_lang FROM T""",
    "alpha_tokens": f"""WITH {T_SQL} SELECT article_url,
        array_to_string(list_filter(tokens, lambda t: regexp_full_match(t, '\\p{{L}}+')), '|') AS tokens FROM T""",
    "lemmatize": f"""WITH {T_SQL}, L AS (SELECT * FROM (VALUES {_lemma_rows}) AS v(lang, word, pos, lemma) WHERE pos = 'n'),
        X AS (SELECT article_url, lang, unnest(tokens) AS word, unnest(range(len(tokens))) AS i FROM T),
        Y AS (SELECT article_url, string_agg(coalesce(lemma, X.word), '|' ORDER BY i) AS lemmas
              FROM X LEFT JOIN L ON X.lang = L.lang AND X.word = L.word GROUP BY article_url)
        SELECT T.article_url, coalesce(lemmas, '') AS lemmas FROM T LEFT JOIN Y USING (article_url)""",
    "render_tokens": f"""WITH {T_SQL}, A AS (SELECT article_url,
          list_filter(tokens, lambda t: regexp_full_match(t, '\\p{{L}}+')) AS t FROM T)
        SELECT article_url, CASE WHEN len(t) = 0 THEN '[]'
          ELSE '[''' || array_to_string(t, ''', ''') || ''']' END AS rendered FROM A""",
    "lang_labels": f"""WITH {H_SQL} SELECT article_url, {LANG_OF} AS lang_name,
        CASE WHEN {LANG_OF} IS NOT NULL THEN lang END AS lang_code,
        CASE is_sarcastic WHEN 1 THEN 'sarcastic' ELSE 'non-sarcastic' END AS article_type,
        CASE is_sarcastic WHEN 1 THEN 'sarcastic' ELSE 'non_sarcastic' END AS file_type FROM H""",
    "registered_domain": f"WITH {HOST_SQL} SELECT page_id, any_domain, domain FROM DOM",
    "registered_domain_table": f"""WITH HP AS (
          SELECT page_id, string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS p FROM pages),
        HT AS (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS k FROM HP),
        HR AS (SELECT page_id, p, array_to_string(p[len(p) - k + 1:], '.') AS rule, 0 AS exception, k AS n FROM HT
               UNION ALL SELECT page_id, p, '*.' || array_to_string(p[len(p) - k + 2:], '.'), 0, k FROM HT WHERE k > 1
               UNION ALL SELECT page_id, p, '!' || array_to_string(p[len(p) - k + 1:], '.'), 1, k - 1 FROM HT),
        HB AS (SELECT page_id, p, n, row_number() OVER (PARTITION BY page_id ORDER BY exception DESC, n DESC) AS i
               FROM HR WHERE rule IN ({listed(SUFFIX_RULES)}))
        SELECT pages.page_id, CASE WHEN len(p) > n THEN array_to_string(p[len(p) - n:], '.') END AS domain
        FROM pages LEFT JOIN HB ON pages.page_id = HB.page_id AND i = 1""",
    "label_counts": f"WITH {H_SQL} SELECT is_sarcastic, count(*) AS n FROM H GROUP BY is_sarcastic",
    "length_stats": f"""WITH {H_SQL} SELECT lang, is_sarcastic, {MEDIAN_MEAN} FROM H
        WHERE title_length > 45 AND title_length < 185 GROUP BY lang, is_sarcastic""",
    "length_stats_all": f"WITH {H_SQL} SELECT {MEDIAN_MEAN} FROM H",
    "length_stats_sets": f"""WITH {H_SQL} SELECT lang, is_sarcastic, {MEDIAN_MEAN} FROM H
        GROUP BY GROUPING SETS ((lang, is_sarcastic), ())""",
    "source_medians": f"""WITH {H_SQL} SELECT source, is_sarcastic, median(title_length) AS median_length
        FROM H GROUP BY source, is_sarcastic""",
    "lang_label_pivot": f"""WITH {H_SQL} SELECT lang, nullif(count(*) FILTER (is_sarcastic = 0), 0) AS label_0,
        nullif(count(*) FILTER (is_sarcastic = 1), 0) AS label_1,
        nullif(count(*) FILTER (is_sarcastic IS NULL), 0) AS label_other FROM H GROUP BY lang""",
    "domain_label_pivot": f"""WITH {HOST_SQL} SELECT domain, nullif(count(*) FILTER (is_sarcastic = 0), 0) AS label_0,
        nullif(count(*) FILTER (is_sarcastic = 1), 0) AS label_1,
        nullif(count(*) FILTER (is_sarcastic IS NULL), 0) AS label_other FROM DOM WHERE domain IS NOT NULL GROUP BY domain""",
    "length_histogram": f"""WITH {H_SQL}
        SELECT lang, is_sarcastic, title_length, count(*) AS frequency, 0 AS level FROM H GROUP BY ALL
        UNION ALL SELECT NULL, is_sarcastic, title_length, count(*), 4 FROM H GROUP BY is_sarcastic, title_length
        UNION ALL SELECT NULL, NULL, title_length, count(*), 6 FROM H GROUP BY title_length""",
    "histogram_summary": f"""WITH {H_SQL}
        SELECT lang, is_sarcastic, median(title_length) AS median_length, min(title_length) AS min_length,
          max(title_length) AS max_length, count(*) AS n, CAST(grouping(lang, is_sarcastic) AS INTEGER) AS level
        FROM H GROUP BY GROUPING SETS ((lang, is_sarcastic), (is_sarcastic), ())""",
    "select_langs": f"WITH {H_SQL} SELECT article_url, lang FROM H WHERE lang IN ('fr', 'es')",
    "holdout_langs": f"""WITH {H_SQL} SELECT article_url, CASE WHEN lang IN ('en', 'fr') THEN 'pool' ELSE 'test' END AS part
        FROM H WHERE lang IS NOT NULL""",
    "stratified_split": f"""WITH {SPLIT_SQL} SELECT article_url, CASE split WHEN 'test' THEN 'test' ELSE 'train' END AS split
        FROM SP""",
    "train_val_test": f"WITH {SPLIT_SQL} SELECT article_url, is_sarcastic, split FROM SP",
    "split_sizes": f"WITH {SPLIT_SQL} SELECT split, count(*) AS n FROM SP GROUP BY split",
    "experiment_grid": f"WITH {GRID_SQL}",
    "split_masks": f"""WITH GRID AS (WITH {GRID_SQL}), {NUMBERED_RUNS_SQL}
        SELECT article_url, {", ".join(f"CAST(sum(CASE WHEN split = '{s}' THEN bit ELSE 0 END) AS BIGINT) AS {s}_of" for s in ("train", "val", "test"))}
        FROM GRID JOIN BITS USING (run) GROUP BY article_url""",
    "run_label_counts": f"""WITH GRID AS (WITH {GRID_SQL}), {H_SQL}
        SELECT run, split, is_sarcastic, count(*) AS n FROM GRID JOIN H USING (article_url) GROUP BY ALL""",
    "run_vocabularies": f"""WITH GRID AS (WITH {GRID_SQL}), {TERMS_SQL},
        RC AS (SELECT run, term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS docs
               FROM GRID JOIN DT USING (article_url) WHERE split = 'train' GROUP BY ALL),
        SIZES AS (SELECT * FROM (VALUES {_sizes}) AS v(run, size))
        SELECT run, term, n, docs FROM RC JOIN SIZES USING (run)
        QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC, term) <= size""",
    "run_transfer": f"""WITH GRID AS (WITH {GRID_SQL}), {NUMBERED_RUNS_SQL}, {H_SQL},
        MR AS (SELECT run, lang, is_sarcastic AS y_true, CAST((title_length + i) % 2 AS INTEGER) AS y_pred
               FROM GRID JOIN BITS USING (run) JOIN H USING (article_url) WHERE split = 'test' AND is_sarcastic IS NOT NULL),
        {macro('MR', ('run', 'lang'), 1.0)} SELECT run, lang, {SCORES} FROM MAC""",
    "term_counts": f"WITH {TERMS_SQL} SELECT term, n, docs FROM TC",
    "vocabulary": f"WITH {TERMS_SQL} SELECT term, n FROM VOC",
    "tfidf": f"""WITH {TERMS_SQL}, N AS (SELECT count(*) AS total FROM H),
        X AS (SELECT article_url, DT.term, tf * (ln((total + 1.0) / (docs + 1.0)) + 1.0) AS w FROM DT JOIN VOC USING (term), N)
        SELECT article_url, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY article_url)), 6) AS tfidf FROM X""",
    "scale_gamma": f"""WITH {TERMS_SQL}, N AS (SELECT count(*) AS total FROM H),
        X AS (SELECT article_url, tf * (ln((total + 1.0) / (docs + 1.0)) + 1.0) AS w FROM DT JOIN VOC USING (term), N),
        U AS (SELECT w / sqrt(sum(w * w) OVER (PARTITION BY article_url)) AS v FROM X),
        S AS (SELECT sum(v) AS s, sum(v * v) AS q, (SELECT count(*) FROM VOC) AS width, (SELECT total FROM N) AS n FROM U)
        SELECT round(1 / (width * (q / (n * width) - pow(s / (n * width), 2))), 6) AS gamma FROM S""",
    "score_softmax": """
        SELECT vec_id, CASE WHEN b > a THEN 1 ELSE 0 END AS is_sarcastic,
          round(greatest(exp(a), exp(b)) / (exp(a) + exp(b)), 6) AS confidence
        FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)""",
    "score_external": f"""WITH {H_SQL},
        C AS (SELECT article_url, trim(regexp_replace(lower(article_title), {PUNCT}, '', 'g'), {space()}) AS clean FROM H),
        S AS (SELECT article_url, CAST(len(list_filter(regexp_split_to_array(clean, '\\s+'), lambda t: t <> '')) AS DOUBLE) AS a
              FROM C)
        SELECT article_url, CASE WHEN 12 - a > a THEN 1 ELSE 0 END AS is_sarcastic,
          round(1 / (1 + exp(-abs(12 - 2 * a))), 6) AS confidence FROM S""",
    "confusion_matrix": f"""WITH {M_SQL} SELECT count(*) FILTER (y_true = 0 AND y_pred = 0) AS true_negative,
        count(*) FILTER (y_true = 0 AND y_pred = 1) AS false_positive,
        count(*) FILTER (y_true = 1 AND y_pred = 0) AS false_negative,
        count(*) FILTER (y_true = 1 AND y_pred = 1) AS true_positive FROM M""",
    "accuracy": f"""WITH {M_SQL} SELECT lang, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM M GROUP BY lang""",
    "macro_prf": f"WITH {M_SQL}, {macro('M', (), 0.0)} SELECT {SCORES} FROM MAC",
    "transfer_matrix": f"""WITH {M_SQL},
        MR AS (SELECT CASE WHEN y_pred = 1 THEN 'flagged' ELSE 'plain' END AS run, * FROM M),
        {macro('MR', ('run', 'lang'), 1.0)} SELECT run, lang, {SCORES} FROM MAC""",
    "leaderboard": f"""WITH {M_SQL}, {macro('M', ('lang',), 0.0)}
        SELECT 'svm' AS family, lang AS run, {SCORES} FROM MAC""",
    "transfer_gap": f"""WITH {M_SQL}, {RUNS_SQL},
        MR AS (SELECT run, list_contains(langs, lang) AS inside, y_true, y_pred FROM RUNS, M),
        {macro('MR', ('run', 'inside'), 0.0)},
        G AS (SELECT run, max(f1) FILTER (inside) AS a, max(f1) FILTER (NOT inside) AS b FROM MAC GROUP BY run)
        SELECT run, round(a, 6) AS f1_trained, round(b, 6) AS f1_unseen, round(a - b, 6) AS gap FROM G""",
}
