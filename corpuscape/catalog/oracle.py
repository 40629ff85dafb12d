"""The same results as DuckDB SQL, for every query SQL can express."""

from __future__ import annotations

from corpuscape.catalog.queries import NOISE_ABOVE, SHIFT, STOPWORDS

WR = r"[\p{L}\p{N}_]"
SP = r"[\s\p{Z}\x1c-\x1f\x85]"
NS = r"[^\s\p{Z}\x1c-\x1f\x85]"
SYM = r"[^\s\p{Z}\x1c-\x1f\x85\p{L}\p{N}_]"
STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"

ORACLE: dict[str, str] = {}


def words(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{NS}+')) AS INTEGER)"


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SP}+', ' ', 'g'))"


def numberless(text: str) -> str:
    """Split into word and non-word runs and blank the runs that are small numbers."""
    runs = f"regexp_extract_all(lower({text}), '{WR}+|[^\\p{{L}}\\p{{N}}_]+')"
    kept = f"list_transform({runs}, lambda r: CASE WHEN regexp_full_match(r, '[1-9]?[0-9]') THEN '' ELSE r END)"
    return squeezed(f"coalesce(array_to_string({kept}, ''), '')")


def unlisted(text: str) -> str:
    tokens = f"regexp_extract_all(lower({text}), '{WR}+')"
    return f"coalesce(array_to_string(list_filter({tokens}, lambda t: t NOT IN {STOP}), ' '), '')"


def pieces(text: str) -> str:
    return f"regexp_extract_all({text}, '{SP}*(?:{WR}{{1,4}}|{SYM})')"


def tokens(text: str) -> str:
    return f"CAST(len({pieces(text)}) + 2 AS INTEGER)"


def capped_words(text: str) -> str:
    return f"coalesce(array_to_string(regexp_extract_all({text}, '{NS}+')[1:450], ' '), '')"


def capped_chars(text: str) -> str:
    return (
        f"CASE WHEN length({text}) <= 2015 THEN {text} "
        f"ELSE regexp_replace({text}[1:2015], '(?s) [^ ]*\\z', '') END"
    )


def truncated(text: str) -> str:
    cut = f"array_to_string({pieces(text)}[1:499], '')"
    return f"CASE WHEN {tokens(text)} <= 500 THEN {text} ELSE {cut} END"


DOCS = """docs AS (SELECT doc_id AS id, source || '/' || doc_id AS title, text, lang, source FROM documents)"""
MEASURED = f"""{DOCS},
measured AS (SELECT *, CAST(length(text) AS INTEGER) AS char_count, {words('text')} AS word_count FROM docs)"""
NUMBERLESS = f"""{DOCS},
stripped AS (SELECT id, {numberless('text')} AS text FROM docs),
measured AS (SELECT *, CAST(length(text) AS INTEGER) AS char_count, {words('text')} AS word_count FROM stripped)"""
TOKENED = f"""capped AS (SELECT doc_id AS id, {capped_words('text')} AS text FROM documents),
tokened AS (SELECT id, CAST(length(text) AS INTEGER) AS char_count, {tokens('text')} AS token_count FROM capped)"""
VECTORS = f"""vectors AS (SELECT vec_id AS id, embedding, label, 'v' || vec_id AS title,
  CASE WHEN embedding[1] > {NOISE_ABOVE} THEN -1 ELSE label END AS cluster FROM embeddings)"""
TFIDF = rf"""{DOCS},
toks AS (SELECT id, unnest(regexp_extract_all(lower(text), '{WR}{{2,}}')) AS term FROM docs),
counts AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY id, term),
total AS (SELECT count(*) AS n FROM docs),
kept AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM counts GROUP BY term
  HAVING count(*) >= 5 AND count(*) <= 0.5 * (SELECT n FROM total) ORDER BY cf DESC, term LIMIT 200000),
vocab AS (SELECT term, df, cf, ln((1 + n) / (1 + df)) + 1 AS idf FROM kept, total),
weighted AS (SELECT id, term, tf, tf * idf AS raw FROM counts JOIN vocab USING (term)),
weights AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM weighted)"""


def planted(noise: bool = True) -> str:
    when = "cluster <> -1 AND " if noise else ""
    return f"""{VECTORS},
moved AS (SELECT id, title, label, cluster, list_transform(embedding, lambda x, i:
  CAST(x AS DOUBLE) + CASE WHEN {when}i = label * 6 + 1 THEN {SHIFT} ELSE 0.0 END) AS m FROM vectors),
planted AS (SELECT id, title, label, cluster,
  list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS v FROM moved)"""


def means(table: str, v: str, where: str = "true") -> str:
    return f"""parts AS (SELECT cluster, generate_subscripts({v}, 1) AS d, CAST(unnest({v}) AS DOUBLE) AS x FROM {table} WHERE {where}),
dims AS (SELECT cluster, d, avg(x) AS x FROM parts GROUP BY cluster, d),
means AS (SELECT cluster, list(x ORDER BY d) AS centre FROM dims GROUP BY cluster)"""


def sql(name: str, text: str) -> None:
    ORACLE[name] = text


# --- sources and sinks --------------------------------------------------------------------

sql("scan_parquet", "SELECT * FROM documents")
sql("scan_parquet_columns", "SELECT doc_id, n_chars FROM documents")
sql("scan_jsonl_dir", f"WITH {DOCS} SELECT id, title, text FROM docs")
sql("parse_json_line", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
sql(
    "fill_defaults",
    "SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality FROM documents LEFT JOIN labels USING (doc_id)",
)
sql(
    "table_inventory",
    # The files are written with up to 2^20 rows a group.
    """SELECT 'documents.parquet' AS file, count(*) AS n_rows, CAST(ceil(count(*) / 1048576) AS INTEGER) AS n_row_groups,
       'doc_id,text,lang,source,n_chars' AS columns FROM documents""",
)
sql(
    "column_extents",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", count(*) AS n_values, count(*) - count({name}) AS n_nulls, {low} AS lowest, {high} AS highest
        FROM orders"""
        for name, low, high in (
            ("o_orderkey", "min(o_orderkey)", "max(o_orderkey)"),
            ("o_custkey", "min(o_custkey)", "max(o_custkey)"),
            ("o_totalprice", "NULL", "NULL"),
            ("o_orderpriority", "NULL", "NULL"),
        )
    ),
)
sql("load_stopwords", "SELECT DISTINCT lower(lang || ' ' || source) AS word FROM documents")
sql(
    "first_fraction",
    """SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n
       FROM documents) WHERE r <= n // 2""",
)
sql("sink_parquet", f"WITH {MEASURED} SELECT id, title, char_count, word_count FROM measured")
PLOT = "round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y"
sql("sink_csv_clusters", f"WITH {VECTORS} SELECT cluster, {PLOT} FROM vectors")
sql("sink_csv_clusters_no_noise", f"WITH {VECTORS} SELECT cluster, {PLOT} FROM vectors WHERE cluster <> -1")
sql(
    "save_weights",
    f"WITH {TFIDF} SELECT id, count(*) AS n_terms, round(sum(weight), 6) AS total FROM weights GROUP BY id",
)
sql(
    "load_weight_rows",
    f"""WITH {TFIDF} SELECT id, string_agg(term, ' ' ORDER BY term) AS terms, round(sum(weight), 6) AS total
    FROM weights WHERE id >= 20 AND id < 60 GROUP BY id""",
)
sql("save_model", f"WITH {TFIDF} SELECT term, df, cf, round(idf, 6) AS idf FROM vocab")

# --- projections and filters --------------------------------------------------------------

sql("char_count", f"WITH {MEASURED} SELECT id, char_count FROM measured")
sql("word_count", f"WITH {MEASURED} SELECT id, word_count FROM measured")
sql("drop_columns", f"WITH {MEASURED} SELECT id, title, char_count, word_count FROM measured")
sql("select_pair", f"WITH {MEASURED} SELECT word_count, char_count FROM measured")
sql("preview", f"WITH {MEASURED} SELECT id, title, word_count FROM measured ORDER BY id LIMIT 5")
sql("prefix_passage", f"WITH {DOCS} SELECT id, 'passage: ' || text AS passage FROM docs")
sql("clipped_char_total", "SELECT CAST(sum(least(length(text), 1000)) AS BIGINT) AS total_chars FROM documents")
sql(
    "spread_vector",
    """SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS x3d,
       round(CAST(embedding[2] AS DOUBLE), 6) AS y3d, round(CAST(embedding[3] AS DOUBLE), 6) AS z3d FROM embeddings""",
)
sql(
    "cast_vectors",
    """SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""",
)
sql("attach_labels", f"WITH {VECTORS} SELECT id, title, cluster FROM vectors")
sql("attach_by_key", "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
sql("attach_stages", ORACLE["attach_by_key"])
sql("nonempty_docs", f"WITH {MEASURED} SELECT id, word_count FROM measured WHERE word_count > 0")
sql(
    "zero_word_report",
    f"""WITH {MEASURED} SELECT count(*) FILTER (word_count = 0) AS zero_docs, count(*) AS n_docs,
        round(count(*) FILTER (word_count = 0) / count(*), 6) AS zero_share FROM measured""",
)
sql(
    "drop_report",
    f"""WITH {MEASURED} SELECT count(*) AS before, count(*) FILTER (word_count >= 4) AS after,
        count(*) FILTER (word_count < 4) AS dropped,
        round(count(*) FILTER (word_count < 4) / count(*), 6) AS dropped_share FROM measured""",
)
sql(
    "length_bands",
    f"""WITH {MEASURED} SELECT id, word_count, '0-500' AS band FROM measured WHERE word_count <= 500
        UNION ALL SELECT id, word_count, '500-1000' FROM measured WHERE word_count > 500 AND word_count <= 1000
        UNION ALL SELECT id, word_count, '0-1000' FROM measured WHERE word_count <= 1000""",
)
sql("short_docs", f"WITH {MEASURED} SELECT id, word_count FROM measured WHERE word_count <= 10")
sql("docs_up_to", f"WITH {MEASURED} SELECT id, word_count FROM measured WHERE word_count <= 2000")
sql("over_word_limit", f"WITH {NUMBERLESS} SELECT count(*) FILTER (word_count > 2200) AS n_over FROM measured")
sql("over_token_limit", f"WITH {TOKENED} SELECT count(*) FILTER (token_count > 514) AS n_over FROM tokened")
sql("token_range", f"WITH {TOKENED} SELECT * FROM tokened WHERE token_count BETWEEN 490 AND 514")
sql("without_noise", f"WITH {VECTORS} SELECT id, cluster FROM vectors WHERE cluster <> -1")
sql("in_clusters", f"WITH {VECTORS} SELECT id, cluster FROM vectors WHERE cluster IN (-1, 3, 7)")

# --- joins --------------------------------------------------------------------------------

sql("stopword_anti_join", f"WITH {DOCS} SELECT id, {unlisted('text')} AS text FROM docs")
sql(
    "cluster_semi_join",
    f"""WITH {VECTORS} SELECT id, cluster FROM vectors WHERE cluster IN
        (SELECT cluster FROM vectors GROUP BY cluster HAVING count(*) >= 40)""",
)
sql(
    "nearest_centroid",
    f"""WITH {VECTORS}, {means('vectors', 'embedding', 'cluster <> -1')},
        gaps AS (SELECT id, m.cluster, round(list_distance(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), centre), 9) AS g
          FROM vectors, means m),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY g, cluster) AS r FROM gaps)
        SELECT id, cluster, round(g, 6) AS distance FROM ranked WHERE r = 1""",
)
sql("tfidf_vocab_join", f"WITH {TFIDF} SELECT id, term, tf, round(raw, 6) AS weight FROM weighted")
LANGUAGE_TERMS = f"""{TFIDF},
components AS (SELECT lang, term, avg(weight) AS b FROM weights JOIN docs USING (id) GROUP BY lang, term),
centres AS (SELECT source AS cluster, lang, CAST(count(*) AS DOUBLE) AS a FROM docs GROUP BY source, lang),
terms AS (SELECT cluster, term, sum(a * b) AS weight FROM centres JOIN components USING (lang) GROUP BY cluster, term)"""
sql("component_term_join", f"WITH {LANGUAGE_TERMS} SELECT cluster, term, round(weight, 6) AS weight FROM terms")
sql(
    "top_terms_per_cluster",
    f"""WITH {LANGUAGE_TERMS}, ranked AS (SELECT *, CAST(row_number() OVER
          (PARTITION BY cluster ORDER BY round(weight, 9) DESC, term) AS INTEGER) AS rank FROM terms)
        SELECT cluster, rank, term, round(weight, 6) AS weight FROM ranked WHERE rank <= 10""",
)

# --- aggregations -------------------------------------------------------------------------


def described(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS n, round(avg({column}), 6) AS mean,
  round(stddev_samp({column}), 6) AS std, CAST(min({column}) AS DOUBLE) AS min,
  quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS median,
  quantile_cont({column}, 0.75) AS q3, CAST(max({column}) AS DOUBLE) AS max FROM measured"""


def binned(source: str, column: str, bins: int, where: str = "true") -> str:
    return f"""{source} , pool AS (SELECT CAST({column} AS DOUBLE) AS x FROM {{table}} WHERE {where}),
ends AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
  CASE WHEN min(x) = max(x) THEN 1.0 ELSE max(x) - min(x) END / {bins}.0 AS w FROM pool),
guess AS (SELECT x, lo, w, least(floor((x - lo) / w), {bins - 1}) AS g FROM pool, ends),
placed AS (SELECT CAST(1 + CASE WHEN x < lo + g * w THEN g - 1
  WHEN x >= lo + (g + 1) * w AND g <> {bins - 1} THEN g + 1 ELSE g END AS INTEGER) AS bin FROM guess),
hist AS (SELECT CAST(b AS INTEGER) AS bin, round(lo + (b - 1) * w, 6) AS lo, round(lo + b * w, 6) AS hi,
  (SELECT count(*) FROM placed WHERE bin = b) AS n FROM range(1, {bins + 1}) t(b), ends)"""


HIST = binned(MEASURED, "word_count", 50).replace("{table}", "measured")
sql("describe_lengths", f"WITH {MEASURED} {described('char_count')} UNION ALL {described('word_count')}")
sql("describe_lengths_cleaned", f"WITH {NUMBERLESS} {described('char_count')} UNION ALL {described('word_count')}")
sql("histogram_auto", f"WITH {HIST} SELECT * FROM hist")
sql(
    "histogram_tokens",
    "WITH " + binned(TOKENED, "token_count", 50).replace("{table}", "tokened") + " SELECT * FROM hist",
)
FIXED = f"""{MEASURED}, hist AS (SELECT CAST(b AS INTEGER) AS bin, (b - 1) * 500 AS lo, b * 500 AS hi,
  (SELECT count(*) FROM measured WHERE word_count >= (b - 1) * 500 AND
    (word_count < b * 500 OR (b = 20 AND word_count = 10000))) AS n FROM range(1, 21) t(b))"""
sql("histogram_fixed", f"WITH {FIXED} SELECT * FROM hist")
sql(
    "running_share",
    f"""WITH {FIXED} SELECT *, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cumulative,
        round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS share FROM hist""",
)
sql(
    "histogram_short",
    "WITH " + binned(MEASURED, "word_count", 40, "word_count <= 2000").replace("{table}", "measured") + " SELECT * FROM hist",
)
sql(
    "histogram_bands",
    f"""WITH {MEASURED} SELECT CASE WHEN b < 20 THEN '0-500' ELSE '500-1000' END AS band, b * 25 AS lo, b * 25 + 25 AS hi,
        (SELECT count(*) FROM measured WHERE (word_count >= b * 25 AND word_count < b * 25 + 25 AND NOT (b = 20 AND word_count = 500))
          OR (b = 19 AND word_count = 500) OR (b = 39 AND word_count = 1000)) AS n FROM range(0, 40) t(b)""",
)
sql(
    "histogram_integer",
    f"""WITH {MEASURED} SELECT CAST(b AS INTEGER) AS value,
        (SELECT count(*) FROM measured WHERE word_count = b) AS n FROM range(0, 11) t(b)""",
)


def boxed(table: str, key: str) -> str:
    return f"""box AS (SELECT {key} AS k, quantile_cont(word_count, 0.25) AS q1, quantile_cont(word_count, 0.5) AS median,
  quantile_cont(word_count, 0.75) AS q3 FROM {table} GROUP BY {key}),
stats AS (SELECT k AS band, q1, median, q3, min(word_count) FILTER (word_count >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
  max(word_count) FILTER (word_count <= q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) AS n_docs
  FROM {table} JOIN box ON {key} = k GROUP BY ALL)"""


sql(
    "boxplot_stats",
    f"WITH {MEASURED}, one AS (SELECT 'all' AS a, word_count FROM measured), {boxed('one', 'a')} SELECT * EXCLUDE (band) FROM stats",
)
sql(
    "boxplot_bands",
    f"""WITH {MEASURED}, banded AS (SELECT '0-500' AS b, word_count FROM measured WHERE word_count <= 500
        UNION ALL SELECT '500-1000', word_count FROM measured WHERE word_count > 500 AND word_count <= 1000
        UNION ALL SELECT '0-1000', word_count FROM measured WHERE word_count <= 1000), {boxed('banded', 'b')} SELECT * FROM stats""",
)
CDF = """SELECT bin, hi AS edge, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cumulative,
  round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS share FROM hist"""
sql("length_cdf", "WITH " + binned(MEASURED, "word_count", 100).replace("{table}", "measured") + CDF)
sql(
    "length_cdf_short",
    "WITH " + binned(MEASURED, "word_count", 100, "word_count <= 1000").replace("{table}", "measured") + CDF,
)
sql(
    "band_counts",
    f"""WITH {MEASURED} SELECT CASE WHEN word_count <= 500 THEN '0-500' WHEN word_count <= 1000 THEN '500-1000'
        ELSE '1000+' END AS band, count(*) AS n_docs FROM measured GROUP BY 1""",
)


def top(source: str, table: str, k: int, text: str = "lower(text)", where: str = "true") -> str:
    return f"""WITH {source}, toks AS (SELECT unnest(regexp_extract_all({text}, '{WR}+')) AS token FROM {table} WHERE {where})
  SELECT token, count(*) AS freq FROM toks GROUP BY token ORDER BY freq DESC, token LIMIT {k}"""


DRAW = "md5('42:' || {key}), {key}"
SAMPLED = f"""{DOCS}, drawn AS (SELECT * FROM docs ORDER BY {DRAW.format(key='id')} LIMIT 50000)"""
sql("top_tokens_sample", top(SAMPLED, "drawn", 30))
sql("top_tokens_short", top(MEASURED, "measured", 20, where="word_count <= 10"))
sql("top_tokens_corpus", top(DOCS, "docs", 100))
sql("top_tokens_threshold", top(DOCS, "docs", 100))
sql("top_tokens_cleaned", top(NUMBERLESS, "measured", 20, "text"))
sql(
    "word_occurrences",
    f"""SELECT CAST(sum(len(list_filter(regexp_extract_all(text, '{WR}+'), lambda t: t = 'der'))) AS BIGINT)
        AS occurrences FROM documents""",
)
sql("long_doc_median", f"WITH {MEASURED} SELECT quantile_cont(word_count, 0.5) AS median_words FROM measured WHERE word_count > 2200")
sql("long_doc_mean", f"WITH {MEASURED} SELECT round(avg(word_count), 6) AS mean_words FROM measured WHERE word_count > 2200")
sql("total_words", f"WITH {NUMBERLESS} SELECT CAST(sum(word_count) AS BIGINT) AS total_words FROM measured")
sql(
    "removed_numbers",
    f"""SELECT CAST(sum(len(list_filter(regexp_extract_all(lower(text), '{WR}+'),
        lambda t: regexp_full_match(t, '[1-9]?[0-9]')))) AS BIGINT) AS removed FROM documents""",
)
sql(
    "chars_by_tokens",
    f"WITH {TOKENED} SELECT token_count, round(avg(char_count), 6) AS mean_chars, count(*) AS n_docs FROM tokened GROUP BY token_count",
)
sql(
    "avg_chars_in_range",
    f"WITH {TOKENED} SELECT round(avg(char_count), 6) AS mean_chars FROM tokened WHERE token_count BETWEEN 490 AND 514",
)
SIZES = "SELECT cluster, count(*) AS n_rows FROM vectors"
sql("cluster_sizes", f"WITH {VECTORS} {SIZES} GROUP BY cluster ORDER BY cluster")
sql("cluster_sizes_no_noise", f"WITH {VECTORS} {SIZES} WHERE cluster <> -1 GROUP BY cluster ORDER BY cluster")
sql("cluster_sizes_desc", f"WITH {VECTORS} {SIZES} GROUP BY cluster ORDER BY n_rows DESC, cluster")
sql("cluster_count", f"WITH {VECTORS} SELECT count(DISTINCT cluster) AS n_clusters FROM vectors WHERE cluster <> -1")
sql("corpus_count", "SELECT count(*) AS n_docs FROM documents")
sql(
    "noise_share",
    f"""WITH {VECTORS} SELECT count(*) FILTER (cluster = -1) AS noise_rows,
        round(count(*) FILTER (cluster = -1) / count(*), 6) AS noise_share FROM vectors""",
)

# --- samples, top-k, sets -----------------------------------------------------------------

EXAMPLES = f"""{VECTORS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {DRAW.format(key='id')}) AS r FROM vectors),
examples AS (SELECT cluster, string_agg(title, '|' ORDER BY r) AS example_titles FROM ranked WHERE r <= 5 GROUP BY cluster)"""
sql("cluster_examples", f"WITH {EXAMPLES} SELECT * FROM examples")
sql("clusters_head", f"WITH {EXAMPLES} SELECT * FROM examples ORDER BY cluster LIMIT 50")
DRAWN_CLUSTERS = f"SELECT cluster FROM (SELECT DISTINCT cluster FROM vectors) ORDER BY {DRAW.format(key='cluster')}"
sql(
    "cluster_stratified_sample",
    f"""WITH {VECTORS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {DRAW.format(key='id')}) AS r
        FROM vectors WHERE cluster IN ({DRAWN_CLUSTERS} LIMIT 10)) SELECT id, cluster FROM ranked WHERE r <= 1000""",
)
sql("top_longest", f"WITH {MEASURED} SELECT title, word_count FROM measured ORDER BY word_count DESC, id LIMIT 20")
sql("exact_sample", f"WITH {SAMPLED} SELECT id, title FROM drawn")
sql(
    "plot_sample",
    f"WITH {VECTORS} SELECT id, cluster, {PLOT} FROM vectors WHERE cluster <> -1 ORDER BY {DRAW.format(key='id')} LIMIT 10000",
)
sql("random_clusters", f"WITH {VECTORS} {DRAWN_CLUSTERS} LIMIT 6")
sql(
    "train_test_split",
    f"""SELECT vec_id AS id, CASE WHEN row_number() OVER (ORDER BY {DRAW.format(key='vec_id')}) <= ceil(0.2 * count(*) OVER ())
        THEN 'test' ELSE 'train' END AS split FROM embeddings""",
)
sql(
    "union_samples",
    f"""WITH {VECTORS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {DRAW.format(key='id')}) AS r FROM vectors)
        SELECT id, cluster FROM ranked WHERE cluster IN (0, 4, 8) AND r <= 1000""",
)
sql("union_batches", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')")
sql("distinct_clusters", f"WITH {VECTORS} SELECT DISTINCT cluster FROM vectors")

# --- text functions -----------------------------------------------------------------------


def per_text(name: str, expression: str, alias: str = "text") -> None:
    sql(name, f"WITH {DOCS} SELECT id, {expression} AS {alias} FROM docs")


per_text("lowercase", "lower(text)")
per_text("tokenize_words", f"coalesce(array_to_string(regexp_extract_all(text, '{WR}+'), '|'), '')", "tokens")
per_text("remove_stopwords", unlisted("text"))
per_text("remove_small_numbers", numberless("text"))
per_text("squeeze_spaces", squeezed("text"))
per_text("cap_words", capped_words("text"))
per_text("cap_chars_word_boundary", capped_chars("text"))
per_text("count_tokens", tokens("text"), "token_count")
per_text("truncate_tokens", truncated("text"))

# --- vectors, features, learning ----------------------------------------------------------


def joined(vector: str) -> str:
    return f"array_to_string(list_transform({vector}, lambda q: CAST(round(q * 1000000.0) AS BIGINT)), ',')"


sql(
    "l2_normalize",
    f"""WITH wide AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
        normed AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM wide)
        SELECT id, {joined('list_transform(v, lambda x: CASE WHEN n = 0 THEN x ELSE x / n END)')} AS unit FROM normed""",
)
sql("tfidf_fit", ORACLE["save_model"])
sql("tfidf_transform", f"WITH {TFIDF} SELECT id, term, round(weight, 6) AS weight FROM weights")
TO_MEAN = """SELECT {key}, round(list_distance({v}, (SELECT list(x ORDER BY d) FROM
  (SELECT d, avg(x) AS x FROM (SELECT generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY d))), 6)
  AS length FROM {table}"""
sql(
    "pca_isometry",
    TO_MEAN.format(key="vec_id AS id", v="list_transform(embedding, lambda x: CAST(x AS DOUBLE))", table="embeddings"),
)
sql(
    "project_centroids",
    f"WITH {VECTORS}, {means('vectors', 'embedding')} " + TO_MEAN.format(key="cluster", v="centre", table="means"),
)
sql(
    "silhouette_score",
    f"""WITH {planted()}, sizes AS (SELECT cluster, count(*) AS n FROM planted GROUP BY cluster),
        sums AS (SELECT a.id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.v, b.v)) AS s
          FROM planted a, planted b WHERE a.id <> b.id GROUP BY a.id, a.cluster, b.cluster),
        avgs AS (SELECT id, own, other, s / (n - CASE WHEN own = other THEN 1 ELSE 0 END) AS m FROM sums JOIN sizes ON other = cluster),
        ab AS (SELECT id, min(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM avgs GROUP BY id)
        SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""",
)
sql(
    "silhouette_score_squared",
    ORACLE["silhouette_score"].replace("sum(list_distance(a.v, b.v))", "sum(list_distance(a.v, b.v) ** 2)"),
)
sql(
    "embed_batches",
    f"""WITH {TFIDF}, hashed AS (SELECT term, md5(term) AS h FROM vocab),
        signs AS (SELECT term, j, 1 - 2 * ((CAST(instr('0123456789abcdef',
            substr(h, CAST(8 * (j // 32) + 8 - (j % 32) // 4 AS BIGINT), 1)) - 1 AS BIGINT) >> CAST(j % 4 AS BIGINT)) & 1) AS s FROM hashed, range(0, 64) t(j)),
        sums AS (SELECT id, j, sum(raw * s) AS x FROM weighted JOIN signs USING (term) GROUP BY id, j),
        found AS (SELECT id, list(x ORDER BY j) AS v FROM sums GROUP BY id),
        filled AS (SELECT id, coalesce(v, list_transform(range(0, 64), lambda z: 0.0)) AS v FROM docs LEFT JOIN found USING (id)),
        normed AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM filled)
        SELECT id, {joined('list_transform(v, lambda x: CASE WHEN n = 0 THEN x ELSE x / n END)')} AS embedding FROM normed""",
)
NEAREST_LABEL = f"""{VECTORS}, {means('vectors', 'embedding')},
gaps AS (SELECT id, label, m.cluster AS guess, round(list_distance(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), centre), 9) AS g
  FROM vectors, means m),
guessed AS (SELECT id, CAST(label AS VARCHAR) AS y, CAST(first(guess ORDER BY g, guess) AS VARCHAR) AS p FROM gaps GROUP BY id, label)"""
sql(
    "classification_report",
    f"""WITH {NEAREST_LABEL}, names AS (SELECT y AS name FROM guessed UNION SELECT p FROM guessed),
        counted AS (SELECT name, (SELECT count(*) FROM guessed WHERE y = name) AS support,
          (SELECT count(*) FROM guessed WHERE p = name) AS guesses,
          (SELECT count(*) FROM guessed WHERE p = name AND y = name) AS hits FROM names),
        scored AS (SELECT *, CASE WHEN guesses = 0 THEN 0 ELSE hits / guesses END AS pr,
          CASE WHEN support = 0 THEN 0 ELSE hits / support END AS re FROM counted),
        full_ AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f FROM scored),
        rows_ AS (SELECT name, pr, re, f, support FROM full_
          UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM full_
          UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f), sum(support) FROM full_
          UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM full_)
        SELECT name, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM rows_""",
)

# --- neighbours and density ---------------------------------------------------------------

RAW = f"{VECTORS}, flat AS (SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM vectors)"


def nearest(table: str, k: int, distance: str) -> str:
    return f"""gaps AS (SELECT a.id, b.id AS neighbour, {distance}(a.v, b.v) AS d FROM {table} a, {table} b WHERE a.id <> b.id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY round(d, 9), neighbour) AS INTEGER) AS rank FROM gaps),
near AS (SELECT id, neighbour, rank, d FROM ranked WHERE rank <= {k})"""


sql(
    "knn_graph",
    f"""WITH {RAW}, {nearest('flat', 30, 'list_cosine_distance')}
        SELECT id, neighbour, rank, round(d, 6) AS distance FROM near""",
)
sql(
    "neighbor_graph",
    f"""WITH RECURSIVE {planted()}, {nearest('planted', 30, 'list_cosine_distance')},
        lists AS (SELECT id, min(d) AS rho, list(d - (SELECT min(m.d) FROM near m WHERE m.id = near.id)) AS gaps, log2(count(*)) AS goal,
          count(*) AS k FROM near GROUP BY id),
        steps AS (SELECT id, 0 AS i, CAST(0.0 AS DOUBLE) AS lo, list_max(gaps) / ln(k / goal) AS hi FROM lists
          UNION ALL SELECT id, i + 1, CASE WHEN heavy THEN lo ELSE mid END, CASE WHEN heavy THEN mid ELSE hi END FROM
            (SELECT s.id, i, lo, hi, (lo + hi) / 2 AS mid,
              list_sum(list_transform(gaps, lambda g: exp(-g / ((lo + hi) / 2)))) > goal AS heavy
              FROM steps s JOIN lists USING (id) WHERE i < 40)),
        sigmas AS (SELECT id, rho, (lo + hi) / 2 AS sigma FROM steps JOIN lists USING (id) WHERE i = 40),
        sides AS (SELECT id AS a, neighbour AS b, exp(-(d - rho) / sigma) AS p FROM near JOIN sigmas USING (id)),
        two AS (SELECT a, b, p FROM sides UNION ALL SELECT b, a, p FROM sides)
        SELECT a, b, round(sum(p) - CASE WHEN count(*) > 1 THEN max(p) * min(p) ELSE 0 END, 6) AS weight FROM two GROUP BY a, b""",
)
REACH = f"""{planted()}, {nearest('planted', 30, 'list_distance')},
cores AS (SELECT id, d AS core FROM near WHERE rank = 30),
edges AS (SELECT least(n.id, neighbour) AS a, greatest(n.id, neighbour) AS b, min(round(greatest(d, p.core, q.core), 9)) AS w
  FROM near n JOIN cores p ON n.id = p.id JOIN cores q ON neighbour = q.id GROUP BY 1, 2)"""
sql("core_distance", f"WITH {REACH} SELECT id, round(core, 6) AS core FROM cores")
sql("mutual_reachability", f"WITH {REACH} SELECT a, b, round(w, 6) AS w FROM edges")
sql(
    "spanning_forest",
    f"""WITH RECURSIVE {REACH}, sorted AS MATERIALIZED (SELECT a, b, w, row_number() OVER (ORDER BY w, a, b) AS i FROM edges),
        names AS (SELECT id, row_number() OVER (ORDER BY id) AS p FROM vectors),
        numbered AS MATERIALIZED (SELECT i, a, b, w, x.p AS pa, y.p AS pb FROM sorted JOIN names x ON a = x.id JOIN names y ON b = y.id),
        grown AS (SELECT CAST(0 AS BIGINT) AS i, (SELECT list(p ORDER BY p) FROM names) AS part, false AS taken
          UNION ALL SELECT n.i, CASE WHEN part[pa] = part[pb] THEN part
            ELSE list_transform(part, lambda q: CASE WHEN q = part[pb] THEN part[pa] ELSE q END) END,
            part[pa] <> part[pb] FROM grown g JOIN numbered n ON n.i = g.i + 1)
        SELECT a, b, round(w, 6) AS w FROM grown JOIN numbered USING (i) WHERE taken""",
)
sql(
    "hdbscan_cluster",
    f"""WITH {VECTORS}, firsts AS (SELECT cluster, min(id) AS f FROM vectors WHERE cluster <> -1 GROUP BY cluster),
        numbers AS (SELECT cluster, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS n FROM firsts)
        SELECT id, coalesce(n, -1) AS cluster FROM vectors LEFT JOIN numbers USING (cluster)""",
)

# --- flows --------------------------------------------------------------------------------

sql(
    "clean_corpus_flow",
    f"""WITH {MEASURED}, cleaned AS (SELECT id, title, {unlisted('text')} AS text FROM measured WHERE word_count > 0)
        SELECT id, title, text, CAST(length(text) AS INTEGER) AS char_count, {words('text')} AS word_count FROM cleaned""",
)
CLEANED = f"""{DOCS}, with_words AS (SELECT * FROM docs WHERE {words('text')} > 0),
unlisted AS (SELECT id, {unlisted('text')} AS text FROM with_words),
before AS (SELECT CAST(length(text) AS INTEGER) AS char_count, {words('text')} AS word_count FROM with_words),
after AS (SELECT CAST(length(text) AS INTEGER) AS char_count, {words('text')} AS word_count FROM unlisted WHERE {words('text')} > 0)"""
sql(
    "clean_lines_flow",
    f"WITH {CLEANED} "
    + " UNION ALL ".join(
        f"SELECT *, '{step}' AS step FROM ({described(col).replace('measured', step)})"
        for step in ("before", "after")
        for col in ("char_count", "word_count")
    ),
)
sql(
    "token_limit_flow",
    f"""WITH {DOCS}, a AS (SELECT id, title, {numberless('text')} AS t FROM docs),
        b AS (SELECT id, title, {words('t')} AS word_count_cleaned, {unlisted('t')} AS text_cleaned FROM a),
        d AS (SELECT *, {capped_words('text_cleaned')} AS text_350_words FROM b),
        e AS (SELECT *, CAST(length(text_350_words) AS INTEGER) AS char_count_350, {capped_chars('text_350_words')} AS text_2015char_clean FROM d)
        SELECT *, {tokens('text_2015char_clean')} AS token_count_350_char, {truncated('text_350_words')} AS text_exact_500 FROM e""",
)

# --- principal axes: the leading eigenvectors of the covariance by repeated squaring --------------------

SQUARINGS = 40


def leading(matrix: str, out: str) -> str:
    """Tables that end in ``out(v, l)``, the leading eigenvector and value of the symmetric ``matrix(a)``. A power of the matrix
    scaled by its trace tends to the projection on that vector, whose longest row is the vector."""
    return f"""{out}_powers AS (SELECT 0 AS step, a AS p FROM {matrix} UNION ALL
          SELECT step + 1, list_transform(p, lambda r: list_transform(p, lambda q: list_dot_product(r, q) / t / t)) FROM
          (SELECT *, list_sum(list_transform(p, lambda r, i: r[i])) AS t FROM {out}_powers WHERE step < {SQUARINGS})),
        {out}_rows AS (SELECT unnest(p) AS r FROM {out}_powers WHERE step = {SQUARINGS}),
        {out}_top AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS v FROM {out}_rows
          ORDER BY list_dot_product(r, r) DESC LIMIT 1),
        {out} AS (SELECT v, list_dot_product(v, list_transform(a, lambda r: list_dot_product(r, v))) AS l FROM {out}_top, {matrix})"""


def without(matrix: str, found: str, out: str) -> str:
    """``out(a)``: the matrix less the part along a vector."""
    return f"""{out} AS (SELECT list_transform(a, lambda r, i: list_transform(r, lambda x, j: x - l * v[i] * v[j])) AS a
        FROM {matrix}, {found})"""


def on_axes(source: str, names: list[str], *kept: str) -> str:
    """Coordinates on three axes of the rows ``e(id, v, kept)`` that ``source`` ends in, without their signs."""
    columns = ", ".join(f"round(abs(list_dot_product(placed.w, a{i}.v)), 6) AS {name}" for i, name in enumerate(names, 1))
    return f"""WITH RECURSIVE {source},
        cells AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
        means AS (SELECT i, avg(x) AS m FROM cells GROUP BY i),
        centred AS (SELECT id, i, x - m AS x FROM cells JOIN means USING (i)),
        columns AS (SELECT i, list(x ORDER BY id) AS xs FROM centred GROUP BY i),
        products AS (SELECT p.i AS i, q.i AS j, list_dot_product(p.xs, q.xs) / (len(p.xs) - 1) AS s FROM columns p, columns q),
        grid AS (SELECT i, list(s ORDER BY j) AS r FROM products GROUP BY i),
        m1 AS (SELECT list(r ORDER BY i) AS a FROM grid),
        {leading("m1", "a1")}, {without("m1", "a1", "m2")}, {leading("m2", "a2")}, {without("m2", "a2", "m3")}, {leading("m3", "a3")},
        placed AS (SELECT id, list(x ORDER BY i) AS w FROM centred GROUP BY id)
        SELECT {", ".join(["id", *kept])}, {columns} FROM placed JOIN e USING (id), a1, a2, a3"""


DOUBLES = "list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v"
sql("pca_project", on_axes(f"e AS (SELECT vec_id AS id, {DOUBLES} FROM embeddings)", ["pc1", "pc2", "pc3"]))
VIEWED = f"""{VECTORS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {DRAW.format(key='id')}) AS r
        FROM vectors WHERE cluster IN ({DRAWN_CLUSTERS} LIMIT 10)),
        e AS (SELECT id, cluster, {DOUBLES} FROM ranked WHERE r <= 1000)"""
sql("cluster_view", on_axes(VIEWED, ["x3d", "y3d", "z3d"], "cluster"))

# Multiplications of the document products with the vector, from one document to the leading component.
MULTIPLIED = 300
sql(
    "svd_leading",
    f"""WITH RECURSIVE {TFIDF},
        terms AS (SELECT id, term, weight FROM weights),
        products AS (SELECT a.id AS i, b.id AS j, sum(a.weight * b.weight) AS s FROM terms a JOIN terms b USING (term) GROUP BY ALL),
        known AS (SELECT DISTINCT id FROM terms),
        full_grid AS (SELECT p.id AS i, q.id AS j, coalesce(s, 0) AS s FROM known p CROSS JOIN known q
          LEFT JOIN products ON i = p.id AND j = q.id),
        grid AS (SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(s ORDER BY j) AS r FROM full_grid GROUP BY i)),
        steps AS (SELECT 0 AS step, list_transform(a, lambda r: CAST(1 AS DOUBLE)) AS v FROM grid UNION ALL
          SELECT step + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM
          (SELECT step, list_transform(a, lambda r: list_dot_product(r, v)) AS w FROM steps, grid WHERE step < {MULTIPLIED})),
        found AS (SELECT v, sqrt(list_dot_product(v, list_transform(a, lambda r: list_dot_product(r, v)))) AS size
          FROM steps, grid WHERE step = {MULTIPLIED}),
        placed AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM known)
        SELECT docs.id, round(abs(coalesce(v[place] * size, 0)), 4) AS leading
        FROM docs LEFT JOIN placed ON docs.id = placed.id CROSS JOIN found""",
)

# --- planted groups: what the operators must find is known -------------------------------------

sql(
    "table_inventory_folders",
    "SELECT lang, CAST(1 AS BIGINT) AS n_files, count(*) AS n_rows FROM documents GROUP BY lang",
)
PLANTED_GROUPS = "SELECT min(vec_id) AS first_id, count(*) AS n_rows FROM embeddings GROUP BY label"
sql("kmeans_fit", PLANTED_GROUPS)
sql("kmeans_large_k", PLANTED_GROUPS)
sql("vector_cluster_flow", PLANTED_GROUPS)
LABEL_SILHOUETTE = (
    ORACLE["silhouette_score"].replace(planted(), planted(noise=False)).replace("FROM planted GROUP BY cluster", "FROM named GROUP BY cluster")
    .replace("FROM planted a, planted b", "FROM named a, named b")
    .replace("sizes AS", "named AS (SELECT id, label AS cluster, v FROM planted), sizes AS", 1)
)
sql(
    "best_k_scan",
    f"""SELECT CAST(k AS INTEGER) AS k, k = 10 AS best, CASE WHEN k = 10 THEN (SELECT silhouette FROM ({LABEL_SILHOUETTE})) END AS silhouette
        FROM range(2, 31) t(k)""",
)
sql(
    "kmeans_thousands",
    """WITH raw AS (SELECT [l_quantity / 50, l_extendedprice / 100000, l_discount * 10, l_tax * 12.5] AS v FROM lineitem),
       unit AS (SELECT list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM raw)
       SELECT count(*) AS n_rows, CAST(2000 AS BIGINT) AS n_clusters,
         round(count(*) * (var_pop(u[1]) + var_pop(u[2]) + var_pop(u[3]) + var_pop(u[4])), 4) AS spread, true AS below_grid FROM unit""",
)
sql(
    "train_classifier",
    """SELECT CAST(i AS INTEGER) AS component, i % 6 = 0 AND i < 60 AS leads
       FROM range(0, (SELECT CAST(max(len(embedding)) AS BIGINT) FROM embeddings)) t(i)""",
)
sql(
    "topic_flow",
    """SELECT count(*) AS n_docs, CAST(29 AS BIGINT) AS n_k, CAST(1 AS BIGINT) AS best, CAST(10 AS BIGINT) AS n_terms,
       true AS same_k FROM documents""",
)
sql(
    "knn_descent",
    """SELECT count(*) AS n_rows, CAST(count(*) * least(30, count(*) - 1) AS BIGINT) AS n_links, true AS ranked, true AS recalled
       FROM embeddings""",
)
sql("graph_layout", "SELECT count(*) AS n_rows, true AS sound, true AS keeps FROM embeddings")
sql("density_cluster_layout", "SELECT label, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_clusters FROM embeddings GROUP BY label")
