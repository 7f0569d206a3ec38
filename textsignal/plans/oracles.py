"""SQL for DuckDB that gives the same rows as the registered queries.

The SQL states each result directly, for instance a split by ranking a whole class,
where the engine avoids that. DuckDB's regular expressions have no look-around and read
``\\b`` as ASCII, so word edges are spelt out, and words are masked token by token.
"""

from __future__ import annotations

from textsignal.fixtures import SCRIPTS, comments_sql
from textsignal.functions.lexicon import (
    AI, AI_SUBSTRINGS, ANXIETY, ANXIETY_SUBSTRINGS, COMMUNITIES, JOB, MODERATE, NEGATIONS,
    OPTIMISM_SUBSTRINGS, SEVERE, STOP_WORDS, Lexicon,
)
from textsignal.functions.text import without_marks

WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_quote(v) for v in values)


def _hit(col: str, words) -> str:
    return f"regexp_matches({col}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(words)})([^\\p{{L}}\\p{{N}}_]|$)')"


def _hits(col: str, lexicon: Lexicon) -> str:
    if lexicon.whole_words:
        tests = [_hit(col, [t]) for t in lexicon.terms]
    else:
        tests = [f"contains({col}, {_quote(t)})" for t in lexicon.terms]
    return "CAST(" + " + ".join(f"CAST({t} AS int)" for t in tests) + " AS int)"


def _scripts(col: str) -> str:
    """Letters in other scripts without their marks: each by way of a sign of its own, so that no result is replaced again."""
    signs = [chr(0xE000 + i) for i in range(len(SCRIPTS))]
    col = f"strip_accents(translate({col}, {_quote(''.join(SCRIPTS))}, {_quote(''.join(signs))}))"
    for sign, letter in zip(signs, SCRIPTS.values(), strict=True):
        col = f"replace({col}, {_quote(sign)}, {_quote(without_marks(letter))})"
    return col


def _merged(col: str) -> str:
    for phrase, token in NEGATIONS:
        pattern = "\\b" + phrase.replace(" ", WS + "+") + "\\b"
        col = f"regexp_replace({col}, {_quote(pattern)}, '{token}', 'g')"
    return col


def _full(col: str) -> str:
    no_links = f"regexp_replace(lower(coalesce({col}, '')), '(http|www\\.)[^\\s\\x0B\\x1C-\\x1F\\x85\\p{{Z}}]+', ' ', 'g')"
    return f"trim(regexp_replace({_merged(no_links)}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def _severity(col: str) -> str:
    return f"CAST(2 * {_hits(col, SEVERE)} + {_hits(col, MODERATE)} AS int)"


def _bucket(score: str) -> str:
    return f"CASE WHEN {score} = 0 THEN 0 WHEN {score} = 1 THEN 1 WHEN {score} <= 3 THEN 2 ELSE 3 END"


def _type(col: str) -> str:
    cases = " ".join(f"WHEN lower({col}) IN ({_list(m)}) THEN '{k}'" for k, m in COMMUNITIES.items())
    return f"CASE {cases} ELSE 'other' END"


LIGHT = (
    "trim(regexp_replace(regexp_replace(lower(body), 'http\\S+|www\\S+', ' ', 'g'), "
    "'[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
)
HASH = "md5(concat('42:', comment_id))"
IS_URLFREE = f"{_hit('clean_body', AI.terms)} AND {_hit('clean_body', JOB.terms)}"
CTES = f"""WITH comments AS ({comments_sql()}),
light AS (SELECT *, {LIGHT} AS clean_body FROM comments),
labelled AS (
  SELECT *, CASE WHEN {_hit('clean_body', ANXIETY.terms)} THEN 1 ELSE 0 END AS label
  FROM light WHERE {IS_URLFREE}
),
cleaned AS (SELECT * REPLACE ({_full('body')} AS clean_body, coalesce(lower(subreddit), 'unknown') AS subreddit) FROM labelled),
prepared AS (SELECT * FROM cleaned WHERE length(clean_body) >= 10),
severe AS (SELECT *, {_severity('lower(body)')} AS severity_score FROM prepared),
levels AS (SELECT *, {_bucket('severity_score')} AS intensity_label FROM severe),
dated AS (SELECT * REPLACE (coalesce(mm, 1) AS mm) FROM prepared WHERE yyyy IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (ORDER BY yyyy, mm, {HASH}, comment_id) AS place, count(*) OVER () AS n FROM dated),
by_time AS (SELECT *, CASE WHEN place <= floor(n * CAST(0.7 AS double)) THEN 'train' ELSE 'test' END AS split FROM ranked),
scored AS (
  SELECT l.doc_id AS comment_id, l.quality AS label, d.n_chars / (d.n_chars + 1000.0::double) AS score
  FROM labels l JOIN documents d USING (doc_id)
),
decided AS (SELECT *, CASE WHEN score >= 0.6::double THEN 1 ELSE 0 END AS prediction FROM scored)
"""
TERMS = f""", masked AS (
  SELECT comment_id, clean_body, array_to_string([w FOR w IN string_split(clean_body, ' ') IF w NOT IN ({_list(ANXIETY.terms)})], ' ') AS shown
  FROM prepared
),
texts AS (SELECT comment_id, regexp_extract_all(strip_accents(lower(shown)), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS all_tokens FROM masked),
words AS (SELECT comment_id, [w FOR w IN @tokens IF w NOT IN (@stop)] AS w FROM texts),
terms AS (
  SELECT comment_id, list_concat(w, [concat(w[i], ' ', w[i + 1]) FOR i IN range(1, greatest(len(w), 1))]) AS terms
  FROM words
),
counted AS (SELECT comment_id, term, count(*) AS tf FROM (SELECT comment_id, unnest(terms) AS term FROM terms) GROUP BY ALL),
vocabulary AS (
  SELECT term, CAST(sum(tf) AS bigint) AS tf, count(*) AS df FROM counted GROUP BY term
  HAVING count(*) >= @min AND count(*) <= 0.95::double * (SELECT count(*) FROM terms)
  ORDER BY 2 DESC, 1 LIMIT @size
),
weights AS (SELECT *, ln((1 + (SELECT count(*) FROM terms)) / (1 + df)::double) + 1 AS idf FROM vocabulary)
"""


_UNMASKED = "clean_body AS shown"
_MASKED = f"array_to_string([w FOR w IN string_split(clean_body, ' ') IF w NOT IN ({_list(ANXIETY.terms)})], ' ') AS shown"


def _terms(tokens: str = "all_tokens", min_df: int = 2, size: int = 30_000, mask: bool = True) -> str:
    shown = TERMS if mask else TERMS.replace(_MASKED, _UNMASKED)
    filled = shown.replace("@tokens", tokens).replace("@min", str(min_df)).replace("@size", str(size))
    return CTES + filled.replace("@stop", _list(STOP_WORDS))


def _entry_counts(mask: bool, columns: str = "") -> str:
    """Non-zero slots per row: terms of the vocabulary, a length above the shortest, one community."""
    return f"""{_terms(mask=mask)}, found AS (
  SELECT comment_id, count(*) AS n FROM counted JOIN vocabulary USING (term) GROUP BY comment_id
)
SELECT comment_id, CAST(coalesce(n, 0) + CASE WHEN length(clean_body) > (SELECT min(length(clean_body)) FROM prepared) THEN 1 ELSE 0 END + 1 AS int) AS n_entries,
  CAST((SELECT count(*) FROM vocabulary) + 1 + (SELECT count(DISTINCT subreddit) FROM prepared) AS int) AS n_slots{columns}
FROM prepared LEFT JOIN found USING (comment_id)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::double ELSE ({a})::double / ({b}) END"


def _binary(table: str, prediction: str = "prediction") -> str:
    tp = f"count(*) FILTER (label = 1 AND {prediction} = 1)"
    said, real = f"count(*) FILTER ({prediction} = 1)", "count(*) FILTER (label = 1)"
    return f"""SELECT {_ratio(f'count(*) FILTER (label = {prediction})', 'count(*)')} AS accuracy,
  {_ratio(tp, said)} AS precision, {_ratio(tp, real)} AS recall,
  {_ratio(f'2 * {tp}', f'{said} + {real}')} AS f1 FROM {table}"""


def _auc(table: str) -> str:
    return f"""(SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END::double) / count(*)
  FROM {table} p, {table} n WHERE p.label = 1 AND n.label = 0)"""


def _summary() -> str:
    parts = []
    for t in (0.3, 0.5, 0.7):
        flag = f"CASE WHEN score >= {t}::double THEN 1 ELSE 0 END"
        parts.append(
            f"SELECT 'length' AS model_name, 'at_{t}' AS split_name, round(accuracy, 4) AS accuracy, "
            f"round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, "
            f"round({_auc('scored')}, 4) AS roc_auc FROM ({_binary('scored', f'({flag})')})"
        )
    return " UNION ALL ".join(parts)


CURVE = """, points AS (
  SELECT t.score AS threshold, count(*) FILTER (s.label = 1) AS tp, count(*) FILTER (s.label = 0) AS fp
  FROM (SELECT DISTINCT score FROM scored) t JOIN scored s ON s.score >= t.score GROUP BY t.score
),
sizes AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored)
"""
RATED = f""", rated AS (
  SELECT comment_id, intensity_label AS label, {_bucket('merged')} AS prediction
  FROM (SELECT *, {_severity('clean_body')} AS merged FROM levels)
),
classes AS (SELECT DISTINCT unnest([label, prediction]) AS c FROM rated),
rates AS (
  SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (prediction = c) AS said,
    count(*) FILTER (label = c) AS real FROM rated CROSS JOIN classes GROUP BY c
),
per_class AS (
  SELECT c, tp, {_ratio('tp', 'said')} AS precision, {_ratio('tp', 'real')} AS recall,
    {_ratio('2 * tp', 'said + real')} AS f1, real::double AS support FROM rates
)
"""


def build() -> dict[str, str]:
    names = "['none', 'low', 'medium', 'high']"
    merged_rare = "CASE WHEN l = 3 AND high < {m} THEN (CASE WHEN medium + high < {m} THEN 1 ELSE 2 END) WHEN l = 2 AND medium + (CASE WHEN high < {m} THEN high ELSE 0 END) < {m} THEN 1 ELSE l END"
    with_sizes = (
        "(SELECT comment_id, intensity_label AS l, count(*) FILTER (intensity_label = 3) OVER () AS high, "
        "count(*) FILTER (intensity_label = 2) OVER () AS medium FROM levels)"
    )
    share = """, sizes AS (SELECT label, count(*) AS n FROM prepared GROUP BY label),
test AS (SELECT *, n * ceil(0.2::double * sum(n) OVER ()) / sum(n) OVER () AS x, ceil(0.2::double * sum(n) OVER ()) AS drawn FROM sizes),
test_n AS (SELECT *, CAST(floor(x) AS bigint) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, label) <= drawn - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS t FROM test),
valid AS (SELECT label, t, n - t AS rest, (n - t) * ceil(0.2::double * sum(n - t) OVER ()) / sum(n - t) OVER () AS y, ceil(0.2::double * sum(n - t) OVER ()) AS drawn FROM test_n),
valid_n AS (SELECT *, CAST(floor(y) AS bigint) + CASE WHEN row_number() OVER (ORDER BY y - floor(y) DESC, label) <= drawn - sum(floor(y)) OVER () THEN 1 ELSE 0 END AS v FROM valid)
"""
    in_class = f"row_number() OVER (PARTITION BY label ORDER BY {HASH}, comment_id)"
    early_share = share.replace("FROM prepared", "FROM by_time WHERE split = 'train'")
    counts = "CAST(count(*) AS bigint)"
    out = {
        "label_distribution": f"SELECT label, {counts} AS count FROM labelled GROUP BY label",
        "a01_read_comments": f"SELECT yyyy, mm, {counts} AS n, CAST(sum(length(body)) AS bigint) AS n_chars, count(subreddit) AS n_named FROM comments GROUP BY yyyy, mm",
        "a02_cast_period": "SELECT comment_id, yyyy, mm FROM comments",
        "a03_read_labelled_csv": f"SELECT comment_id, md5(body) AS body_md5, subreddit, yyyy, mm, md5(clean_body) AS clean_md5, label, {_type('subreddit')} AS subreddit_type FROM labelled",
        "a04_write_labelled": f"SELECT yyyy, mm, label, {counts} AS n, CAST(sum(length(clean_body)) AS bigint) AS n_chars FROM labelled GROUP BY yyyy, mm, label",
        "a05_reuse_stage": "SELECT label, count(*) AS n, (SELECT count(*) FROM labelled) AS n_first, (SELECT count(*) FROM labelled WHERE yyyy = 2024) AS n_other, CAST(1 AS INTEGER) AS n_stages FROM labelled GROUP BY label",
        "a06_write_result": f"SELECT label, {counts} AS count FROM labelled GROUP BY label",
        "a07_markdown": f"SELECT model_name, split_name, printf('| %s | %s | %.4f | %.4f | %.4f | %.4f | %.4f |', model_name, split_name, accuracy, precision, recall, f1, roc_auc) AS line FROM ({_summary()})",
        "b01_clean_light": "SELECT comment_id, clean_body FROM light",
        "b02_clean_full": f"SELECT comment_id, {_full('body')} AS clean_body FROM comments",
        "b03_merge_negations": f"SELECT comment_id, {_merged('lower(body)')} AS merged FROM comments",
        "b04_ai_filter": f"SELECT comment_id FROM light WHERE {_hit('clean_body', AI.terms)}",
        "b05_job_filter": f"SELECT comment_id FROM light WHERE {IS_URLFREE}",
        "b06_weak_label": f"SELECT comment_id, CASE WHEN {_hit('clean_body', ANXIETY.terms)} THEN 1 ELSE 0 END AS label FROM light",
        "b07_keyword_count": f"SELECT comment_id, {_hits('lower(body)', ANXIETY)} AS n_anxiety, {_hits('lower(body)', AI)} AS n_ai, {_hits('lower(body)', JOB)} AS n_job FROM comments",
        "b08_severity": f"SELECT comment_id, {_severity('lower(body)')} AS severity_score FROM comments",
        "b09_intensity": f"SELECT comment_id, severity_score, {_bucket('severity_score')} AS intensity_label FROM (SELECT comment_id, {_severity('lower(body)')} AS severity_score FROM comments)",
        "b10_merge_rare": f"SELECT comment_id, {merged_rare.format(m=5)} AS merged_5, {merged_rare.format(m=50)} AS merged_50 FROM {with_sizes}",
        "b11_community_type": f"SELECT comment_id, {_type('subreddit')} AS subreddit_type FROM comments",
        "b12_valid_labels": "SELECT comment_id, CAST(x AS int) AS label FROM (SELECT comment_id, try_cast((['x', '1.0', ' 0', '2', '', '1'])[comment_id % 6 + 1] AS double) AS x FROM comments) WHERE x IN (0, 1)",
        "b13_min_length": f"SELECT conv_id, turn, CAST(length(t) AS int) AS n_chars FROM (SELECT conv_id, turn, {_full('text')} AS t FROM conversations) WHERE length(t) >= 10",
        "b14_normal_community": "SELECT comment_id, coalesce(lower(subreddit), 'unknown') AS subreddit FROM comments",
        "b15_projection": "SELECT comment_id, clean_body, subreddit FROM prepared",
        "b16_keyword_masker": f"SELECT comment_id, array_to_string([CASE WHEN w IN ({_list(ANXIETY.terms)}) THEN ' ' ELSE w END FOR w IN string_split(clean_body, ' ')], ' ') AS masked FROM prepared",
        "b17_text_length": "SELECT comment_id, CAST(length(clean_body) AS int) AS text_len FROM prepared",
        "b18_time_keys": "SELECT comment_id, yyyy, coalesce(CASE WHEN comment_id % 9 NOT IN (0, 2) THEN mm END, 1) AS mm FROM comments WHERE yyyy IS NOT NULL",
        "b19_intensity_name": f"SELECT comment_id, ({names})[intensity_label + 1] AS intensity FROM levels",
        "b20_round": "SELECT comment_id, round(score, 4) AS score FROM scored",
        "c01_pool_size": "SELECT count(*) AS n_candidates FROM labelled",
        "c02_label_distribution": "SELECT label, count(*) AS count FROM prepared GROUP BY label",
        "c03_community_distribution": "SELECT subreddit, count(*) AS count FROM labelled GROUP BY subreddit",
        "c04_community_label": "SELECT subreddit, label, count(*) AS count FROM prepared GROUP BY subreddit, label",
        "c05_intensity_distribution": f"SELECT ({names})[label_id + 1] AS intensity, label_id, count(*) AS count FROM (SELECT {merged_rare.format(m=50)} AS label_id FROM {with_sizes}) GROUP BY label_id",
        "c06_label_quality": f"SELECT count(*) AS n_positive, count(*) FILTER (k = 1) AS n_single, CAST(round_even(100.0::double * count(*) FILTER (k = 1) / greatest(count(*), 1), 0) AS bigint) AS single_pct FROM (SELECT {_hits('lower(body)', ANXIETY)} AS k FROM prepared WHERE label = 1)",
        "c07_positive_check": "SELECT count(*) AS n_rows, count(*) FILTER (label = 1) AS n_positive, 100.0::double * count(*) FILTER (label = 1) / count(*) AS positive_pct, count(*) FILTER (label = 1) < 200 AS low_positive FROM prepared",
        "c08_class_summary": "SELECT string_agg(intensity_label::varchar, ',' ORDER BY intensity_label) AS classes, min(n) AS smallest FROM (SELECT intensity_label, count(*) AS n FROM levels GROUP BY intensity_label)",
        "c09_split_audit": "SELECT split, count(*) AS n_rows, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative, split = 'train' AND count(*) < 500 AS small_train FROM by_time GROUP BY split",
        "d01_top_k_per_class": f"SELECT comment_id, label FROM prepared QUALIFY {in_class} <= 100",
        "d02_shuffle": "SELECT comment_id, md5(concat('44:', comment_id)) AS row_hash FROM labelled",
        "d03_union": "SELECT comment_id, label FROM labelled WHERE label = 1 UNION ALL SELECT comment_id, label FROM labelled",
        "d03b_union_metrics": " UNION ALL ".join(f"SELECT {t}::double AS at, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM ({_binary('scored', f'(CASE WHEN score >= {t}::double THEN 1 ELSE 0 END)')})" for t in (0.3, 0.5, 0.7)),
        "d05_plain_split": f"SELECT comment_id, CASE WHEN row_number() OVER (ORDER BY {HASH}, comment_id) <= ceil(0.2::double * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM prepared",
        "d06_downsample": f"SELECT comment_id, label FROM prepared QUALIFY label = 1 OR {in_class} <= count(*) FILTER (label = 1) OVER ()",
        "d07_temporal_split": "SELECT comment_id, yyyy, mm, split FROM by_time",
        "d08_folds": f"SELECT comment_id, label, CAST(ntile(3) OVER (PARTITION BY label ORDER BY {HASH}, comment_id) - 1 AS int) AS fold FROM prepared",
        "e01_tokens": "SELECT comment_id, array_to_string(regexp_extract_all(strip_accents(lower(body)), '[\\p{L}\\p{N}_]{2,}'), ' ') AS tokens FROM comments",
        "e13_scripts": f"SELECT comment_id, array_to_string(regexp_extract_all({_scripts('lower(body)')}, '[\\p{{L}}\\p{{N}}_]{{2,}}'), ' ') AS tokens FROM comments",
        "e02_stop_words": f"SELECT comment_id, array_to_string([w FOR w IN regexp_extract_all(strip_accents(lower(clean_body)), '[\\p{{L}}\\p{{N}}_]{{2,}}') IF w NOT IN ({_list(STOP_WORDS)})], ' ') AS words FROM prepared",
        "e07_constant_fill": "SELECT comment_id, coalesce(mm, 0) AS mm FROM comments",
        "e08_min_max": "SELECT comment_id, round((length(clean_body) - lo) / (hi - lo)::double, 6) AS scaled FROM prepared CROSS JOIN (SELECT min(length(clean_body)) AS lo, max(length(clean_body)) AS hi FROM prepared WHERE yyyy = 2023)",
        "e09_most_frequent_fill": "SELECT comment_id, coalesce(subreddit, (SELECT subreddit FROM comments WHERE subreddit IS NOT NULL GROUP BY subreddit ORDER BY count(*) DESC, subreddit LIMIT 1)) AS subreddit FROM comments",
        "e10_one_hot": "SELECT p.comment_id, p.subreddit, CAST(coalesce(s.slot, -1) AS int) AS slot FROM prepared p LEFT JOIN (SELECT subreddit, row_number() OVER (ORDER BY subreddit) - 1 AS slot FROM (SELECT DISTINCT subreddit FROM prepared WHERE label = 1 AND subreddit <> 'other')) s USING (subreddit)",
        "f03_class_weights": "SELECT comment_id, label, round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY label))::double, 6) AS w_balanced, CASE WHEN label = 1 THEN 5.0::double ELSE 1.0::double END AS w_5, CASE WHEN label = 1 THEN 10.0::double ELSE 1.0::double END AS w_10 FROM prepared",
        "f07_apply_threshold": "SELECT comment_id, label, prediction FROM decided",
        "g01_binary_metrics": f"SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({_binary('decided')})",
        "g02_auc": f"SELECT round({_auc('scored')}, 6) AS roc_auc",
        "g03_confusion": "SELECT a AS actual, p AS predicted, count(comment_id) AS count FROM (VALUES (0), (1)) x(a) CROSS JOIN (VALUES (0), (1)) y(p) LEFT JOIN decided ON label = a AND prediction = p GROUP BY a, p",
        "g07_pr_baseline": "SELECT round(avg(label), 6) AS baseline FROM scored",
        "g11_summary": _summary(),
        "x01_optimism": f"SELECT comment_id, {_hits('lower(body)', OPTIMISM_SUBSTRINGS)} AS n_optimism, {_hits('lower(body)', OPTIMISM_SUBSTRINGS)} > 0 AS optimistic FROM comments",
        "x02_substring_lexicons": f"SELECT comment_id, {_hits('lower(body)', AI_SUBSTRINGS)} AS n_ai, {_hits('lower(body)', ANXIETY_SUBSTRINGS)} AS n_anxiety FROM comments",
        "x03_year_split": "SELECT comment_id, CASE WHEN yyyy = 2023 THEN 'train' ELSE 'test' END AS split FROM comments WHERE yyyy IN (2023, 2024)",
        "x06_stages": f"SELECT 'filtered' AS stage, label, count(*) AS n FROM labelled GROUP BY label UNION ALL SELECT 'labelled', label, count(*) FROM labelled GROUP BY label UNION ALL SELECT 'features', label, count(*) FROM (SELECT label, {_full('body')} AS clean_body FROM labelled) WHERE length(clean_body) >= 10 GROUP BY label",
        "x07_whole_stages": f"SELECT 'filtered' AS stage, count(*) AS n FROM labelled UNION ALL SELECT 'labelled', count(*) FROM labelled UNION ALL SELECT 'features', count(*) FROM (SELECT {_full('body')} AS clean_body FROM labelled) WHERE length(clean_body) >= 10",
    }
    out = {name: CTES + sql for name, sql in out.items()}
    out |= {
        "d04_stratified_split": f"{CTES}{share}SELECT comment_id, label, CASE WHEN k <= t THEN 'test' WHEN k <= t + v THEN 'validation' ELSE 'train' END AS split FROM (SELECT comment_id, label, {in_class} AS k FROM prepared) JOIN valid_n USING (label)",
        "d09_inner_validation": f"{CTES}{early_share}SELECT comment_id, label, CASE WHEN k <= t AND n_rows > 50 AND n_pos >= 5 THEN 'validation' ELSE 'train' END AS split FROM (SELECT comment_id, label, {in_class} AS k, count(*) OVER () AS n_rows, count(*) FILTER (label = 1) OVER () AS n_pos FROM by_time WHERE split = 'train') JOIN valid_n USING (label)",
        "e03_bigrams": f"{_terms()}SELECT comment_id, CAST(len(terms) AS int) AS n_terms, md5(array_to_string(terms, '|')) AS terms_md5 FROM terms",
        "e04_vocabulary": f"{_terms()}SELECT term, tf, df FROM vocabulary",
        "e05_idf": f"{_terms()}SELECT term, round(idf, 6) AS idf FROM weights",
        "e06_tfidf": f"{_terms()}SELECT comment_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY comment_id)), 6) AS weight FROM (SELECT comment_id, term, c.tf * idf AS x FROM counted c JOIN weights USING (term))",
        "e11_assemble": _entry_counts(True),
        "e12_variants": f"SELECT * FROM ({_entry_counts(True, ', ' + _quote('masked') + ' AS variant')}) UNION ALL SELECT * FROM ({_entry_counts(False, ', ' + _quote('unmasked') + ' AS variant')})",
        "x04_vocabulary_limits": f"{_terms('all_tokens[1:200]', 5, 20_000)}SELECT term, tf, df FROM vocabulary",
        "f06_best_threshold": f"{CTES}{CURVE}SELECT round(coalesce(max(threshold), 0.5::double), 6) AS threshold FROM (SELECT threshold FROM (SELECT threshold, tp / (tp + fp)::double AS p, tp / sizes.p::double AS r FROM points CROSS JOIN sizes) WHERE r >= 0.1::double ORDER BY 2 * p * r / (p + r + 1e-9) DESC, threshold LIMIT 1)",
        "g04_report": f"{CTES}{RATED}SELECT ({names})[c + 1] AS class_name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per_class UNION ALL SELECT 'accuracy', a, a, a, a FROM (SELECT round(sum(tp) / sum(support), 6) AS a FROM per_class) UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support) FROM per_class UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support) FROM per_class",
        "g05_roc_curve": f"{CTES}{CURVE}SELECT round(threshold, 6) AS threshold, round(fp / n::double, 6) AS fpr, round(tp / p::double, 6) AS tpr FROM (SELECT *, lag(tp) OVER w AS tp0, lag(fp) OVER w AS fp0, lead(tp) OVER w AS tp1, lead(fp) OVER w AS fp1 FROM points WINDOW w AS (ORDER BY threshold DESC)) CROSS JOIN sizes WHERE tp0 IS NULL OR tp1 IS NULL OR tp1 - 2 * tp + tp0 <> 0 OR fp1 - 2 * fp + fp0 <> 0 UNION ALL SELECT 'infinity'::double, 0.0::double, 0.0::double",
        "g06_pr_curve": f"{CTES}{CURVE}SELECT round(threshold, 6) AS threshold, round(tp / (tp + fp)::double, 6) AS precision, round(tp / p::double, 6) AS recall FROM points CROSS JOIN sizes UNION ALL SELECT NULL, 1.0::double, 0.0::double",
        "g08_mean_f1": f"{CTES}{RATED}SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM per_class",
        "g09_ordinal_mae": f"{CTES}{RATED}SELECT round(avg(abs(label - prediction)), 6) AS mae FROM rated",
    }
    return out
