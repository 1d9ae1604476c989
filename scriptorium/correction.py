"""Queries of the post-correction operators over the token, kbest, dictionary and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.common import read_table, stage_table
from scriptorium.functions import text as X
from scriptorium.operators import align, annotate, bins, dictionary, hmm, index, report, views
from scriptorium.operators import tokens as T
from scriptorium.plans import prepare
from scriptorium.sources import files

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a function ``(spark, sf_dir)`` under its name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------------------------------------
# Tables and their SQL

TOK = """tok AS (
  SELECT doc_id, doc_index, original, gold, coalesce(hyphenated, false) AS is_hyphenated, coalesce(discarded, false) AS is_discarded,
         coalesce(has_error, false) AS has_error, CASE WHEN bin > 0 THEN bin END AS bin, heuristic, selection, token_type, token_info, annotations, last_modified
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, doc_index ORDER BY last_modified DESC NULLS LAST, loaded_at DESC NULLS LAST, original DESC NULLS LAST,
          gold DESC NULLS LAST, hyphenated DESC NULLS LAST, discarded DESC NULLS LAST, has_error DESC NULLS LAST, bin DESC NULLS LAST, heuristic DESC NULLS LAST,
          selection DESC NULLS LAST, token_type DESC NULLS LAST, token_info DESC NULLS LAST, annotations DESC NULLS LAST) AS rn
        FROM token WHERE doc_id IS NOT NULL AND doc_index IS NOT NULL) WHERE rn = 1)"""
KB = """kb AS (
  SELECT doc_id, doc_index, k, candidate, probability::DOUBLE AS probability
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, doc_index, k ORDER BY loaded_at DESC NULLS LAST, candidate DESC NULLS LAST, probability DESC NULLS LAST) AS rn
        FROM kbest WHERE doc_id IS NOT NULL AND doc_index IS NOT NULL AND k IS NOT NULL) WHERE rn = 1)"""
# greedy pairing over the whole document: place in the run of eligible rows, odd places are heads
PAIRED = """numbered AS (SELECT *, sum(CASE WHEN able THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY doc_index) AS grp FROM able),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp, able ORDER BY doc_index) AS pos FROM numbered),
headed AS (SELECT *, able AND pos % 2 = 1 AS head FROM placed),
pair AS (SELECT *, coalesce(lag(head) OVER w, false) AS consumed, lead(original) OVER w AS next_original, lead(gold) OVER w AS next_gold, lead(doc_index) OVER w AS next_index
         FROM headed WINDOW w AS (PARTITION BY doc_id ORDER BY doc_index))"""
CONS = f"""{TOK}, able AS (SELECT *, is_hyphenated AND NOT is_discarded AS able FROM tok), {PAIRED},
cons AS (SELECT doc_id, doc_index, heuristic, bin, selection, head AS is_joined,
  CASE WHEN head THEN original || CASE WHEN next_index IS NULL THEN '-' ELSE next_original END ELSE original END AS original,
  CASE WHEN head AND gold <> '' THEN gold || CASE WHEN next_index IS NULL THEN '-' ELSE next_gold END ELSE gold END AS gold
  FROM pair WHERE NOT consumed AND NOT is_discarded)"""
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
QUOTES = "»«“”„›‹"
ASCII_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def clean_sql(x: str) -> str:
    return f"trim(replace(replace({x}, chr(173), ''), '-', ''), '{PUNCT}{QUOTES}' || {ASCII_BLANK})"


def letters_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\p{{L}}'))"


SPACES = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.current(read_table(spark, sf_dir, "token"))


def _kbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.candidates(read_table(spark, sf_dir, "kbest"))


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.add_words(read_table(spark, sf_dir, "dict_words"))


# ---------------------------------------------------------------------------------------------
# Sources and scalar expressions


@query(f"SELECT doc_id, (i - 1)::INTEGER AS doc_index, w[i] AS original FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '') AS w FROM documents))")
def tokenize(spark, sf_dir):
    return T.tokenize(read_table(spark, sf_dir, "documents"))


@query(f"WITH {TOK} SELECT doc_id, doc_index, coalesce(nullif(gold, ''), original) AS string, gold IS NOT NULL AS is_corrected, is_discarded, coalesce(heuristic = 'annotator', false) AS requires_annotator, has_error, epoch(last_modified)::BIGINT AS last_modified_s FROM tok")
def overview(spark, sf_dir):
    return T.overview(_tokens(spark, sf_dir))


@query(
    f"WITH w AS (SELECT DISTINCT original AS word FROM token WHERE original IS NOT NULL) SELECT word, {clean_sql('word')} AS cleaned, {letters_sql('word')}::INTEGER AS n_letters, "
    "regexp_full_match(word, '\\p{P}+') AS is_punctuation, regexp_full_match(word, '\\p{N}+') AS is_numeric, regexp_matches(word, '[\\x{ad}\\-]+$') AS ends_in_hyphen, "
    f"trim(trim(lower(word), '{PUNCT}'), {ASCII_BLANK}) AS term_key, md5(word) AS digest FROM w"
)
def word_classes(spark, sf_dir):
    w = F.col("word")
    words = read_table(spark, sf_dir, "token").select(F.col("original").alias("word")).where("word IS NOT NULL").distinct()
    return words.select(
        "word", X.clean(w).alias("cleaned"), X.letters(w).alias("n_letters"), X.is_punctuation(w).alias("is_punctuation"), X.is_numeric(w).alias("is_numeric"), X.ends_in_hyphen(w).alias("ends_in_hyphen"), X.term_key(w).alias("term_key"), F.md5(w).alias("digest")
    )


@query("SELECT DISTINCT doc_id, original_path, regexp_extract(original_path, '([^/]*?)(\\.[^./]*)?$', 1) AS stem, regexp_extract(original_path, '(\\.[^./]*)$', 1) AS suffix, coalesce(lower(is_done::VARCHAR) IN ('yes', 'true', 't', 'y', '1'), false) AS done FROM doc_catalog")
def document_paths(spark, sf_dir):
    c = read_table(spark, sf_dir, "doc_catalog")
    return c.select("doc_id", "original_path", X.stem(F.col("original_path")).alias("stem"), X.suffix(F.col("original_path")).alias("suffix"), X.truth(F.col("is_done").cast("string")).alias("done")).distinct()


# ---------------------------------------------------------------------------------------------
# Sequences


@query(f"WITH {CONS} SELECT doc_id, doc_index, original, gold, is_joined, heuristic, bin, selection FROM cons")
def consolidated(spark, sf_dir):
    return T.consolidated(_tokens(spark, sf_dir))


RENDER = f"""WITH {TOK}, able AS (SELECT *, is_hyphenated AS able FROM tok), {PAIRED},
shown AS (SELECT *, coalesce(nullif(gold, ''), original) AS shown, coalesce(nullif(next_gold, ''), next_original) AS next_shown FROM pair),
words AS (SELECT doc_id, doc_index, CASE WHEN head THEN substr(shown, 1, length(shown) - 1) || CASE WHEN next_index IS NULL THEN '-' ELSE next_shown END ELSE shown END AS word FROM shown WHERE NOT consumed)
"""


@query(RENDER + "SELECT doc_id, (doc_index // 4096)::INTEGER AS piece, string_agg(word, ' ' ORDER BY doc_index) AS text FROM words GROUP BY ALL")
def render_text(spark, sf_dir):
    return T.render(_tokens(spark, sf_dir))


@query(RENDER + "SELECT doc_id, string_agg(word, ' ' ORDER BY doc_index) AS text FROM words GROUP BY doc_id")
def document_texts(spark, sf_dir):
    return T.document_texts(_tokens(spark, sf_dir))


@query(
    f"""WITH {TOK}, kept AS (SELECT * FROM tok WHERE NOT is_discarded), able AS (SELECT *, is_hyphenated AS able FROM kept), {PAIRED},
shown AS (SELECT *, coalesce(nullif(gold, ''), original) AS shown, coalesce(nullif(next_gold, ''), next_original) AS next_shown FROM pair)
SELECT doc_id, string_agg(CASE WHEN head THEN substr(shown, 1, length(shown) - 1) || CASE WHEN next_index IS NULL THEN '-' ELSE next_shown END ELSE shown END, ' ' ORDER BY doc_index) AS text FROM shown WHERE NOT consumed GROUP BY doc_id"""
)
def corrected_texts(spark, sf_dir):
    """The text of every document as its gold file would have it, finished or not."""
    return prepare.corrected_texts(_tokens(spark, sf_dir), only_done=False)


@query(f"WITH {TOK}, asked AS (SELECT DISTINCT doc_id, doc_index FROM kbest) SELECT a.doc_id, a.doc_index, t.original, t.gold, CASE WHEN t.doc_id IS NULL THEN 404 ELSE 200 END AS status FROM asked a LEFT JOIN tok t ON t.doc_id = a.doc_id AND t.doc_index = a.doc_index")
def token_lookup(spark, sf_dir):
    """The tokens candidates name, found or not."""
    return T.lookup(_tokens(spark, sf_dir), read_table(spark, sf_dir, "kbest")).select("doc_id", "doc_index", "original", "gold", "status")


@query(f"WITH {TOK}, c AS (SELECT doc_id, doc_index, max(candidate) AS gold FROM kbest WHERE k = 1 AND doc_id IS NOT NULL AND doc_index IS NOT NULL GROUP BY ALL) SELECT t.doc_id, t.doc_index, CASE WHEN c.doc_id IS NULL THEN t.gold ELSE c.gold END AS gold, is_discarded FROM tok t LEFT JOIN c ON c.doc_id = t.doc_id AND c.doc_index = t.doc_index")
def apply_corrections(spark, sf_dir):
    """First candidates taken over as a file of corrections."""
    rows = read_table(spark, sf_dir, "kbest").where("k = 1").select("doc_id", "doc_index", F.col("candidate").alias("gold"))
    return prepare.apply_corrections(_tokens(spark, sf_dir), rows).select("doc_id", "doc_index", "gold", "is_discarded")


@query(
    f"WITH {TOK}, able AS (SELECT *, regexp_matches(original, '[\\x{{ad}}\\-]+$') AS able FROM tok), {PAIRED} "
    "SELECT doc_id, doc_index, original, is_hyphenated OR head AS is_hyphenated, CASE WHEN consumed THEN '' ELSE gold END AS gold FROM pair"
)
def dehyphenate(spark, sf_dir):
    return T.dehyphenate(_tokens(spark, sf_dir))


COUNTED = """kept AS (SELECT *, NOT consumed AND NOT is_discarded AS k, coalesce(heuristic = 'annotator', false) AS hand FROM pair),
counted AS (SELECT doc_id, count(*) AS index_count, count(*) FILTER (NOT consumed AND is_discarded) AS discarded_count, count(*) FILTER (k) AS token_count,
  count(*) FILTER (k AND is_hyphenated) AS hyphenated_count, count(*) FILTER (k AND has_error) AS error_count,
  count(*) FILTER (k AND NOT has_error AND gold IS NULL) AS uncorrected_count, count(*) FILTER (k AND NOT has_error AND gold IS NOT NULL) AS corrected_count,
  count(*) FILTER (k AND NOT has_error AND gold IS NOT NULL AND hand) AS corrected_by_annotator_count,
  count(*) FILTER (k AND NOT has_error AND gold IS NOT NULL AND NOT hand) AS corrected_by_model_count,
  count(*) FILTER (k AND NOT has_error AND gold = '') AS empty_gold_count FROM kept GROUP BY doc_id),
stats AS (SELECT *, token_count > 0 AND corrected_count = token_count AND error_count = 0 AS done FROM counted)"""
STATS = f"""WITH {TOK}, able AS (SELECT *, is_hyphenated AND NOT is_discarded AS able FROM tok), {PAIRED},
{COUNTED},
ready AS (SELECT doc_id, count(*) FILTER (heuristic IS NULL AND NOT is_discarded) = 0 AS ready, bool_and(heuristic IS NOT NULL AND NOT is_discarded) AS ready_strict,
  max(last_modified) AS last_modified, max(doc_index) AS max_index FROM tok GROUP BY doc_id)
"""


@query(STATS + "SELECT * FROM stats")
def doc_stats(spark, sf_dir):
    return T.doc_stats(_tokens(spark, sf_dir))


@query(
    STATS + "SELECT doc_id, corrected_count = corrected_by_annotator_count + corrected_by_model_count AS parts_add_up, token_count = corrected_count + uncorrected_count AS tokens_add_up, "
    "index_count = token_count + hyphenated_count + discarded_count AS rows_add_up, error_count = 0 AS no_errors, done FROM stats"
)
def validate_stats(spark, sf_dir):
    return T.validate_stats(T.doc_stats(_tokens(spark, sf_dir)))


@query(STATS + "SELECT * FROM ready")
def server_ready(spark, sf_dir):
    return T.server_ready(_tokens(spark, sf_dir))


HELD = """held AS (SELECT doc_id, ext, original_path, gold_path, coalesce(is_done, false) AS is_done, added_at, removed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY added_at DESC NULLS LAST, removed_at DESC NULLS LAST, ext DESC NULLS LAST, original_path DESC NULLS LAST, gold_path DESC NULLS LAST, is_done DESC NULLS LAST) AS rn
  FROM doc_catalog WHERE doc_id IS NOT NULL) WHERE rn = 1)"""


@query(f"WITH {HELD} SELECT * FROM held")
def document_catalog(spark, sf_dir):
    return views.held_documents(read_table(spark, sf_dir, "doc_catalog"))


@query(f"WITH {HELD} SELECT doc_id, ext FROM held WHERE ext = '.pdf' AND is_done")
def select_documents(spark, sf_dir):
    return views.select_documents(views.held_documents(read_table(spark, sf_dir, "doc_catalog")), ext=".pdf", done=True).select("doc_id", "ext")


@query(
    STATS.rstrip() + f", {HELD} SELECT s.doc_id, done, token_count, corrected_count, uncorrected_count, error_count FROM stats s JOIN held h ON s.doc_id = h.doc_id "
    "WHERE NOT h.is_done AND token_count > 0 AND uncorrected_count > 0 AND corrected_count + error_count < token_count"
)
def doc_index_page(spark, sf_dir):
    return views.index_page(views.held_documents(read_table(spark, sf_dir, "doc_catalog")), T.doc_stats(_tokens(spark, sf_dir)))


@query(STATS + "SELECT s.doc_id, token_count, corrected_count, error_count, done, ready, last_modified FROM stats s JOIN ready r ON s.doc_id = r.doc_id")
def doc_stats_list(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return views.stats_list(T.doc_stats(t), T.server_ready(t))


@query(
    f"""WITH {TOK}, {KB}, kl AS (SELECT doc_id, doc_index, string_agg(k || ':' || candidate, '|' ORDER BY k) AS candidates FROM kb GROUP BY ALL),
n AS (SELECT *, lead(original) OVER w AS no, lead(gold) OVER w AS ng, coalesce(lag(is_hyphenated) OVER w, false) AS redirects_to_head FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY doc_index)),
d AS (SELECT *, regexp_replace(original, '\\x{{ad}}$', '-') AS o, regexp_replace(gold, '\\x{{ad}}$', '-') AS g FROM n)
SELECT d.doc_id, d.doc_index, CASE WHEN is_hyphenated THEN o || coalesce(no, '') ELSE o END AS original,
  CASE WHEN is_hyphenated THEN CASE WHEN gold <> '' AND ng <> '' THEN g || ng END ELSE g END AS gold,
  redirects_to_head, '/images/' || d.doc_id || '/' || d.doc_index || '.png' AS image_url,
  CASE WHEN original LIKE '%' || chr(173) THEN replace(candidates, chr(173), '-') ELSE candidates END AS candidates FROM d LEFT JOIN kl ON kl.doc_id = d.doc_id AND kl.doc_index = d.doc_index"""
)
def token_detail(spark, sf_dir):
    shown = T.token_detail(T.with_candidates(_tokens(spark, sf_dir), _kbest(spark, sf_dir)))
    listed = F.array_join(F.transform("candidates", lambda c: F.concat(c["k"].cast("string"), F.lit(":"), c["candidate"])), "|")
    return shown.withColumn("candidates", F.when(F.size("candidates") > 0, listed))


@query(
    f"""WITH {TOK}, n AS (SELECT doc_id, doc_index, original, heuristic, coalesce(array_to_string(list(original) OVER (PARTITION BY doc_id ORDER BY doc_index ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), ' '), '') AS left_context,
  coalesce(array_to_string(list(original) OVER (PARTITION BY doc_id ORDER BY doc_index ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), ' '), '') AS right_context FROM tok)
SELECT doc_id, doc_index, original, left_context, right_context FROM n WHERE heuristic = 'annotator'"""
)
def context_window(spark, sf_dir):
    return T.context(_tokens(spark, sf_dir), F.col("heuristic") == "annotator")


@query(
    f"""WITH {TOK}, n AS (SELECT *, coalesce(heuristic = 'annotator', false) AS hand FROM tok),
m AS (SELECT *, lead(hand) OVER w AS nh, lag(hand) OVER w AS ph, lag(is_hyphenated) OVER w AS pf FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY doc_index))
SELECT doc_id, doc_index FROM m WHERE nh IS NOT NULL AND ph IS NOT NULL AND (hand OR nh OR ph OR pf) AND NOT is_discarded"""
)
def precache_candidates(spark, sf_dir):
    return T.precache_candidates(_tokens(spark, sf_dir))


@query(STATS.rstrip() + f", {HELD} SELECT h.doc_id, coalesce(s.done, h.is_done) AS is_done FROM held h LEFT JOIN stats s ON s.doc_id = h.doc_id")
def documents_done(spark, sf_dir):
    return views.mark_done(views.held_documents(read_table(spark, sf_dir, "doc_catalog")), T.doc_stats(_tokens(spark, sf_dir))).select("doc_id", "is_done")


@query(f"WITH {HELD} SELECT doc_id FROM held ORDER BY md5('5' || chr(31) || doc_id), doc_id LIMIT 1")
def random_document(spark, sf_dir):
    return views.random_document(views.held_documents(read_table(spark, sf_dir, "doc_catalog")), seed=5)


@query(f"WITH {TOK} SELECT doc_id, doc_index FROM tok WHERE heuristic = 'annotator' ORDER BY md5('11' || chr(31) || doc_id || chr(31) || doc_index), doc_id, doc_index LIMIT 1")
def random_token(spark, sf_dir):
    return views.random_token(_tokens(spark, sf_dir), F.col("heuristic") == "annotator", seed=11)


# ---------------------------------------------------------------------------------------------
# Page geometry

BOX = f"""{TOK}, box AS (
  SELECT doc_id, doc_index, original, gold, is_discarded, TRY_CAST(token_info->>'$[0]' AS INTEGER) AS page, TRY_CAST(token_info->>'$[1]' AS INTEGER) AS x0, TRY_CAST(token_info->>'$[2]' AS INTEGER) AS y0,
    TRY_CAST(token_info->>'$[3]' AS INTEGER) AS x1, TRY_CAST(token_info->>'$[4]' AS INTEGER) AS y1, TRY_CAST(token_info->>'$[6]' AS INTEGER) AS block, TRY_CAST(token_info->>'$[7]' AS INTEGER) AS line, TRY_CAST(token_info->>'$[8]' AS INTEGER) AS word_no
  FROM tok WHERE token_type = 'PDFToken' AND token_info LIKE '[%'
  UNION ALL SELECT doc_id, doc_index, original, gold, is_discarded, TRY_CAST(token_info->>'$.page' AS INTEGER), {", ".join(f"coalesce(TRY_CAST(regexp_extract(token_info->>'$.bbox', 'bbox (\\d+) (\\d+) (\\d+) (\\d+)', {k}) AS INTEGER), 0)" for k in range(1, 5))},
    1, TRY_CAST(token_info->>'$.line' AS INTEGER), 0 FROM tok WHERE token_type = 'HOCRToken' AND token_info LIKE '{{%'),
boxes AS (SELECT * FROM box WHERE page IS NOT NULL)"""


def _boxes(spark, sf_dir):
    return T.boxes(_tokens(spark, sf_dir))


@query(f"WITH {BOX} SELECT doc_id, doc_index, page, x0, y0, x1, y1, block, line, word_no FROM boxes")
def hocr_parse(spark, sf_dir):
    return _boxes(spark, sf_dir).drop("original", "gold", "is_discarded")


CROP = f"""WITH {BOX},
cover AS (SELECT doc_id, page, unnest(generate_series(x0, x1 - 1)) AS x FROM boxes WHERE x1 > x0),
cols AS (SELECT doc_id, page, x, count(*) AS n FROM cover GROUP BY ALL),
span AS (SELECT doc_id, page, min(x) AS lo, max(x) AS hi FROM cols GROUP BY ALL),
hist AS (SELECT doc_id, page, lo, hi, CASE WHEN hi = lo THEN 51 ELSE least(100, (x - lo) * 100 // (hi - lo) + 1) END AS bin, sum(n) AS n FROM cols JOIN span USING (doc_id, page) GROUP BY ALL),
every AS (SELECT s.doc_id, s.page, s.lo, s.hi, g.i AS bin, coalesce(h.n, 0) AS n FROM span s CROSS JOIN generate_series(1, 100) AS g(i) LEFT JOIN hist h ON h.doc_id = s.doc_id AND h.page = s.page AND h.bin = g.i),
low AS (SELECT *, n <= 0.1 * max(n) OVER (PARTITION BY doc_id, page) AS low FROM every),
edges AS (SELECT doc_id, page, coalesce(round(any_value(lo) + (max(bin) FILTER (low AND bin <= 20) - 1) * (any_value(hi) - any_value(lo)) / 100.0, 6), 0.0)::DOUBLE AS left_edge,
  coalesce(round(any_value(lo) + max(bin) FILTER (low AND bin > 80) * (any_value(hi) - any_value(lo)) / 100.0, 6), any_value(hi) + 1.0)::DOUBLE AS right_edge FROM low GROUP BY doc_id, page)
"""


@query(CROP + "SELECT * FROM edges")
def crop_edges(spark, sf_dir):
    return T.crop_edges(_boxes(spark, sf_dir))


@query(CROP + "SELECT doc_id, doc_index, page FROM boxes JOIN edges USING (doc_id, page) WHERE NOT (x1 >= left_edge AND x0 <= right_edge)")
def crop_tokens(spark, sf_dir):
    found = _boxes(spark, sf_dir)
    return T.outside_edges(found, T.crop_edges(found))


@query(
    f"""WITH {BOX}, s AS (SELECT *, coalesce(nullif(gold, ''), original) AS text, round((y1 - y0) * 0.71::DOUBLE, 3) AS font_size FROM boxes WHERE NOT is_discarded)
SELECT doc_id, page, block, line, word_no, doc_index, x0, y0, greatest(x1::DOUBLE, round(x0 + length(text) * font_size / 2 + 10.0::DOUBLE, 3)) AS x1, y1, font_size, text FROM s WHERE text <> ''"""
)
def layout_rows(spark, sf_dir):
    return T.in_page_order(T.layout(_boxes(spark, sf_dir)))


@query(
    f"WITH {BOX}, p AS (SELECT doc_id, page, max(x1) AS width, max(y1) AS height FROM boxes GROUP BY ALL) SELECT doc_id, doc_index, page, greatest(0, x0 - 300) AS crop_x0, greatest(0, y0 - 15) AS crop_y0, least(width, x1 + 300) AS crop_x1, least(height, y1 + 15) AS crop_y1 FROM boxes JOIN p USING (doc_id, page)"
)
def snippet_rectangles(spark, sf_dir):
    return T.snippets(_boxes(spark, sf_dir))


@query(
    f"WITH {BOX}, w AS (SELECT *, regexp_replace(original, '^{SPACES}|{SPACES}$', '', 'g') AS word FROM boxes) "
    "SELECT doc_id || '/' || page AS doc_id, (row_number() OVER (PARTITION BY doc_id, page ORDER BY doc_index) - 1)::INTEGER AS doc_index, x0, y0, x1, y1, word AS original FROM w WHERE word <> ''"
)
def hocr_round_trip(spark, sf_dir):
    """Every scanned page written as hOCR and parsed again."""
    pages = files.to_hocr(_boxes(spark, sf_dir))
    return files.parse_hocr(pages.select(F.concat_ws("/", "doc_id", "page").alias("doc_id"), "xml"))


@query(f"WITH {BOX}, w AS (SELECT doc_id, page, max(x1) + 1.0 AS width FROM boxes GROUP BY ALL), o AS (SELECT doc_id, doc_index, true AS outside FROM boxes JOIN w USING (doc_id, page) WHERE NOT (x1 >= 70 AND x0 <= width)) SELECT t.doc_id, t.doc_index, CASE WHEN outside THEN '' ELSE gold END AS gold, is_discarded OR coalesce(outside, false) AS is_discarded FROM tok t LEFT JOIN o USING (doc_id, doc_index)")
def cropped_tokens(spark, sf_dir):
    found = _boxes(spark, sf_dir)
    outside = T.outside_edges(found, T.edges_or(found, left=70))
    return T.cropped(_tokens(spark, sf_dir), outside).select("doc_id", "doc_index", "gold", "is_discarded")


@query(f"WITH {TOK} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY doc_index) - 1)::INTEGER AS doc_index, original FROM tok WHERE NOT is_discarded")
def renumbered(spark, sf_dir):
    return T.renumbered(_tokens(spark, sf_dir).where("NOT is_discarded").select("doc_id", "doc_index", "original"))


@query(f"WITH {TOK} SELECT * FROM tok")
def record_round_trip(spark, sf_dir):
    return T.from_records(T.to_records(_tokens(spark, sf_dir)))


# ---------------------------------------------------------------------------------------------
# Dictionary

DICT = f"""dict AS (SELECT DISTINCT group_name, unnest(string_split(c, ' ')) AS word FROM (SELECT group_name, {clean_sql('word')} AS c FROM dict_words) WHERE c <> '' AND {letters_sql('c')} > 0),
dict_word AS (SELECT DISTINCT word FROM dict WHERE word <> '')"""


def known_sql(x: str) -> str:
    return f"({clean_sql(x)} = '' OR {letters_sql(clean_sql(x))} <= 1 OR {clean_sql(x)} IN (SELECT word FROM dict_word))"


@query(f"WITH {DICT} SELECT group_name, word FROM dict WHERE word <> ''")
def dictionary_build(spark, sf_dir):
    return _dictionary(spark, sf_dir)


@query(f"WITH {DICT}, w AS (SELECT DISTINCT original AS word FROM token WHERE original IS NOT NULL) SELECT word, {known_sql('word')} AS known FROM w")
def dictionary_membership(spark, sf_dir):
    return dictionary.known_words(read_table(spark, sf_dir, "token").select(F.col("original").alias("word")), _dictionary(spark, sf_dir))


@query(
    f"WITH {CONS}, {COUNTED}, {DICT}, g AS (SELECT DISTINCT 'gold-' || doc_id AS group_name, {clean_sql('gold')} AS word FROM cons WHERE heuristic = 'annotator' AND gold <> '' AND doc_id IN (SELECT doc_id FROM stats WHERE done)) "
    f"SELECT group_name, word FROM g WHERE {letters_sql('word')} > 1 AND word NOT IN (SELECT word FROM dict_word)"
)
def dictionary_new_words(spark, sf_dir):
    """Words annotators wrote in documents complete by their counts."""
    t = _tokens(spark, sf_dir)
    done = T.doc_stats(t).where("done").select("doc_id")
    return dictionary.new_words(T.consolidated(t.join(done, "doc_id", "left_semi")), _dictionary(spark, sf_dir))


@query(f"WITH {CONS}, {DICT}, g AS (SELECT DISTINCT 'gold-' || doc_id AS group_name, {clean_sql('gold')} AS word FROM cons WHERE heuristic = 'annotator' AND gold <> '') SELECT group_name, word FROM g WHERE {letters_sql('word')} > 1 AND word NOT IN (SELECT word FROM dict_word)")
def annotator_words(spark, sf_dir):
    """The same over all documents, finished or not."""
    return dictionary.new_words(_words(spark, sf_dir), _dictionary(spark, sf_dir))


@query(f"WITH {DICT} SELECT group_name, count(DISTINCT word) AS n_words FROM dict WHERE word <> '' GROUP BY ALL UNION ALL SELECT '*', count(DISTINCT word) FROM dict WHERE word <> ''")
def dictionary_size(spark, sf_dir):
    return dictionary.group_sizes(_dictionary(spark, sf_dir))


@query(f"WITH {DICT}, a AS (SELECT DISTINCT word FROM dict WHERE group_name = 'corpus_da' AND word <> ''), b AS (SELECT DISTINCT word FROM dict WHERE group_name = 'corpus_sv' AND word <> '') (SELECT word FROM a EXCEPT SELECT word FROM b) UNION ALL (SELECT word FROM b EXCEPT SELECT word FROM a)")
def dictionary_difference(spark, sf_dir):
    d = _dictionary(spark, sf_dir)
    return dictionary.symmetric_difference(d.where("group_name = 'corpus_da'").select("word"), d.where("group_name = 'corpus_sv'").select("word"))


@query(
    f"""WITH {CONS}, {DICT}, g AS (SELECT DISTINCT doc_id, {clean_sql('gold')} AS word FROM cons WHERE heuristic = 'annotator' AND gold <> ''),
f AS (SELECT doc_id, count(*) AS n FROM g WHERE {letters_sql('word')} > 1 AND word NOT IN (SELECT word FROM dict_word) GROUP BY doc_id)
SELECT t.doc_id, count(*) FILTER (NOT is_discarded) AS token_count, count(*) FILTER (heuristic = 'annotator' AND gold IS NOT NULL) AS human_count, coalesce(any_value(f.n), 0) AS new_words FROM tok t LEFT JOIN f ON f.doc_id = t.doc_id GROUP BY t.doc_id"""
)
def session_metrics(spark, sf_dir):
    return views.session_metrics(_tokens(spark, sf_dir), _dictionary(spark, sf_dir))


# ---------------------------------------------------------------------------------------------
# Alignment and model

PAIRS = f"""{CONS}, pairs AS (SELECT original, gold, count(*) AS n FROM cons WHERE original IS NOT NULL AND gold IS NOT NULL GROUP BY ALL),
chars AS (SELECT original, gold, n, i - 1 AS position, substr(original, i, 1) AS orig_char, substr(gold, i, 1) AS gold_char FROM (SELECT *, unnest(generate_series(1, least(length(original), length(gold)))) AS i FROM pairs)),
rc AS (SELECT orig_char, gold_char, sum(n)::BIGINT AS n FROM chars GROUP BY ALL)"""
# letters are characters here, not clusters, so both sides count code points


def _words(spark, sf_dir):
    return T.consolidated(_tokens(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT * FROM rc")
def read_counts(spark, sf_dir):
    return align.read_counts(_words(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def full_alignments(spark, sf_dir):
    return align.full_alignments(_words(spark, sf_dir))


@query(f"WITH {CONS} SELECT original, doc_id, doc_index, gold FROM cons WHERE original IS NOT NULL AND gold IS NOT NULL")
def word_alignments(spark, sf_dir):
    return align.word_alignments(_words(spark, sf_dir))


MODEL = f"""WITH {CONS}, {COUNTED}, {HELD}, {DICT},
finished AS (SELECT doc_id FROM held WHERE is_done UNION SELECT doc_id FROM stats WHERE done),
pairs AS (SELECT original, gold, count(*) AS n FROM cons WHERE gold IS NOT NULL AND doc_id IN (SELECT doc_id FROM finished) GROUP BY ALL),
{PAIRS[PAIRS.index("chars AS"):]},
charset AS (SELECT unnest(string_split('{hmm.CHARACTERS}', '')) AS ch),
gw AS (SELECT gold AS word, sum(n)::BIGINT AS n FROM pairs WHERE gold <> '' GROUP BY ALL UNION ALL SELECT word, 1 FROM dict_word),
exploded AS (SELECT word, n, substr(word, i, 1) AS ch, substr(word, i, 2) AS two FROM (SELECT *, unnest(generate_series(1, length(word))) AS i FROM gw)),
removed AS (SELECT unnest([' ', chr(9), chr(10), chr(13), chr(65279)]) AS ch),
cc AS (SELECT ch, sum(n)::BIGINT AS n FROM exploded WHERE ch NOT IN (SELECT ch FROM removed) AND ch IN (SELECT ch FROM charset) GROUP BY ALL),
fl AS (SELECT substr(word, 1, 1) AS ch, sum(n)::BIGINT AS n FROM gw WHERE word <> '' GROUP BY ALL),
bg AS (SELECT substr(two, 1, 1) AS src, substr(two, 2, 1) AS dst, sum(n)::BIGINT AS n FROM exploded WHERE length(two) = 2 GROUP BY ALL),
conf AS (SELECT gold_char AS state, orig_char AS obs, n FROM rc WHERE length(gold_char) = 1 AND length(orig_char) = 1 AND gold_char NOT IN (SELECT ch FROM removed) AND orig_char NOT IN (SELECT ch FROM removed)),
states AS (SELECT ch FROM charset UNION SELECT ch FROM cc UNION SELECT state FROM conf)
"""


def _finished(spark, sf_dir):
    return views.finished(views.held_documents(read_table(spark, sf_dir, "doc_catalog")), T.doc_stats(_tokens(spark, sf_dir)))


def _gold_words(spark, sf_dir):
    words = prepare.training_words(_tokens(spark, sf_dir), _finished(spark, sf_dir))
    return words.unionByName(_dictionary(spark, sf_dir).select("word").distinct().withColumn("n", F.lit(1).cast("long")))


def _tables(spark, sf_dir):
    return prepare.train_model(_tokens(spark, sf_dir), _finished(spark, sf_dir), _dictionary(spark, sf_dir))


@query(MODEL + "SELECT * FROM cc")
def char_counts(spark, sf_dir):
    return hmm.char_counts(_gold_words(spark, sf_dir), hmm.CHARACTERS)


@query(MODEL + "SELECT * FROM fl")
def first_letters(spark, sf_dir):
    return hmm.first_letters(_gold_words(spark, sf_dir))


@query(MODEL + "SELECT * FROM bg")
def bigrams(spark, sf_dir):
    return hmm.bigrams(_gold_words(spark, sf_dir))


def _shown(df: DataFrame) -> DataFrame:
    """Probabilities as printed: the logarithm to six places; none for 0."""
    return df.withColumn("log_p", F.round(F.log10(F.when(F.col("p") > 0, F.col("p"))), 6)).drop("p")


@query(MODEL + "SELECT s.ch AS state, round(log10((coalesce(fl.n, 0) + 0.0001::DOUBLE) / ((SELECT sum(n) FROM fl)::DOUBLE + 0.0001::DOUBLE * (SELECT count(*) FROM states))), 6) AS log_p FROM states s LEFT JOIN fl ON fl.ch = s.ch")
def hmm_init(spark, sf_dir):
    return _shown(_tables(spark, sf_dir)[0])


@query(
    MODEL + "SELECT a.ch AS src, b.ch AS dst, round(log10((coalesce(bg.n, 0) + 0.0001::DOUBLE) / (coalesce(t.n, 0)::DOUBLE + 0.0001::DOUBLE * (SELECT count(*) FROM states))), 6) AS log_p "
    "FROM states a CROSS JOIN states b LEFT JOIN bg ON bg.src = a.ch AND bg.dst = b.ch LEFT JOIN (SELECT src, sum(n) AS n FROM bg GROUP BY src) t ON t.src = a.ch"
)
def hmm_tran(spark, sf_dir):
    return _shown(_tables(spark, sf_dir)[1])


@query(
    MODEL.rstrip() + """, er AS (SELECT * FROM conf UNION ALL SELECT ch, ch, n FROM cc WHERE ch NOT IN (SELECT state FROM conf)),
et AS (SELECT state, sum(n) AS n FROM er GROUP BY state), eo AS (SELECT DISTINCT obs FROM er)
SELECT a.ch AS state, b.ch AS obs, CASE WHEN a.ch = b.ch THEN 0.0::DOUBLE WHEN et.n IS NOT NULL AND eo.obs IS NOT NULL
  THEN round(log10((coalesce(er.n, 0) + 0.0001::DOUBLE) / (et.n::DOUBLE + 0.0001::DOUBLE * (SELECT count(*) FROM eo))), 6) END AS log_p
FROM states a CROSS JOIN states b LEFT JOIN er ON er.state = a.ch AND er.obs = b.ch LEFT JOIN et ON et.state = a.ch LEFT JOIN eo ON eo.obs = b.ch"""
)
def hmm_emis(spark, sf_dir):
    return _shown(_tables(spark, sf_dir)[2])


@query(MODEL + "SELECT count(*) AS n_states, true AS tran_states_equal, true AS emis_states_equal, true AS tran_rows_full FROM states")
def hmm_valid(spark, sf_dir):
    return hmm.validity(*_tables(spark, sf_dir))


def _model(spark, sf_dir):
    return hmm.Model.collect(*_tables(spark, sf_dir))


# The beams and paths of a word begin with those of its prefixes, so prefixes are worked out once.
SEARCH = MODEL.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
st AS MATERIALIZED (SELECT ch, row_number() OVER (ORDER BY ch) AS i FROM states),
pi AS MATERIALIZED (SELECT s.ch, s.i, (coalesce(fl.n, 0) + 0.0001::DOUBLE) / ((SELECT sum(n) FROM fl)::DOUBLE + 0.0001::DOUBLE * (SELECT count(*) FROM states)) AS p FROM st s LEFT JOIN fl ON fl.ch = s.ch),
pt AS MATERIALIZED (SELECT a.ch AS src, b.ch AS dst, a.i AS si, b.i AS di, (coalesce(bg.n, 0) + 0.0001::DOUBLE) / (coalesce(t.n, 0)::DOUBLE + 0.0001::DOUBLE * (SELECT count(*) FROM states)) AS p
  FROM st a CROSS JOIN st b LEFT JOIN bg ON bg.src = a.ch AND bg.dst = b.ch LEFT JOIN (SELECT src, sum(n) AS n FROM bg GROUP BY src) t ON t.src = a.ch),
er AS (SELECT * FROM conf UNION ALL SELECT ch, ch, n FROM cc WHERE ch NOT IN (SELECT state FROM conf)),
et AS (SELECT state, sum(n) AS n FROM er GROUP BY state), eo AS (SELECT DISTINCT obs FROM er),
pe AS MATERIALIZED (SELECT a.ch AS state, b.ch AS obs, CASE WHEN a.ch = b.ch THEN 1.0::DOUBLE WHEN et.n IS NOT NULL AND eo.obs IS NOT NULL
  THEN (coalesce(er.n, 0) + 0.0001::DOUBLE) / (et.n::DOUBLE + 0.0001::DOUBLE * (SELECT count(*) FROM eo)) ELSE 0.0::DOUBLE END AS p
  FROM states a CROSS JOIN states b LEFT JOIN er ON er.state = a.ch AND er.obs = b.ch LEFT JOIN et ON et.state = a.ch LEFT JOIN eo ON eo.obs = b.ch),
"""
BEAMS = """pre AS MATERIALIZED (SELECT DISTINCT left(word, i) AS pre, left(word, i - 1) AS parent, substr(word, i, 1) AS ch, i AS n FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM asked)),
two AS (SELECT x.pre, 2 AS n, t.src || t.dst AS txt, t.dst AS last, ((i.p * coalesce(e0.p, 0)) * t.p) * coalesce(e1.p, 0) AS p
  FROM pre x JOIN pt t ON true JOIN pi i ON i.ch = t.src LEFT JOIN pe e0 ON e0.state = t.src AND e0.obs = x.parent LEFT JOIN pe e1 ON e1.state = t.dst AND e1.obs = x.ch WHERE x.n = 2),
best AS (SELECT pre, max(p, 4)[-1] AS least FROM two GROUP BY pre),
seed AS (SELECT two.pre, n, txt, last, p, row_number() OVER (PARTITION BY two.pre ORDER BY p DESC, txt) AS rn FROM two JOIN best ON best.pre = two.pre AND p >= least),
beam AS (SELECT pre, n, txt, last, p, rn FROM seed WHERE rn <= 4
  UNION ALL SELECT pre, n, txt, last, p, rn FROM (
    SELECT x.pre, b.n + 1 AS n, b.txt || t.dst AS txt, t.dst AS last, (b.p * t.p) * coalesce(e.p, 0) AS p, row_number() OVER (PARTITION BY x.pre ORDER BY (b.p * t.p) * coalesce(e.p, 0) DESC, b.txt || t.dst) AS rn
    FROM beam b JOIN pre x ON x.parent = b.pre AND x.n = b.n + 1 JOIN pt t ON t.src = b.last LEFT JOIN pe e ON e.state = t.dst AND e.obs = x.ch) WHERE rn <= 4),
short AS (SELECT x.pre, i.ch AS txt, i.p * coalesce(e.p, 0) AS p, row_number() OVER (PARTITION BY x.pre ORDER BY i.p * coalesce(e.p, 0) DESC, i.ch) AS rn FROM pre x JOIN pi i ON true LEFT JOIN pe e ON e.state = i.ch AND e.obs = x.ch WHERE x.n = 1),
reading AS (SELECT a.word, b.rn AS k, b.txt AS candidate, b.p FROM asked a JOIN beam b ON b.pre = a.word UNION ALL SELECT a.word, s.rn, s.txt, s.p FROM asked a JOIN short s ON s.pre = a.word WHERE s.rn <= 4
  UNION ALL SELECT word, unnest([1, 2, 3, 4]), '', 0.0 FROM asked WHERE word = '')
"""
ASKED = "asked AS MATERIALIZED (SELECT DISTINCT original AS word FROM cons WHERE original IS NOT NULL),\n"
LOG = "CASE WHEN p > 0 THEN round(log10(p), 6) END AS log_p"


def _candidates(found: DataFrame) -> DataFrame:
    p = F.col("c.probability")
    return found.select("word", F.explode("kbest").alias("c")).select("word", "c.k", "c.candidate", F.round(F.log10(F.when(p > 0, p)), 6).alias("log_p"))


@query(SEARCH + ASKED + BEAMS + f"SELECT word, k::INTEGER AS k, candidate, {LOG} FROM reading")
def kbest(spark, sf_dir):
    """k-best candidates under the trained model for every distinct joined word."""
    return _candidates(hmm.kbest_words(_words(spark, sf_dir).select(F.col("original").alias("word")), _model(spark, sf_dir)))


# Groups of characters read for one, for this query.
GROUPS = {"ce": ["æ"], "rn": ["m"], "cl": ["d"]}
# each occurrence of a group stays or is replaced, one group at a time
VARIANTS = """words AS MATERIALIZED (SELECT DISTINCT original AS word FROM cons WHERE original IS NOT NULL),
grp AS (SELECT * FROM (VALUES """ + ", ".join(f"('{g}', '{r[0]}')" for g, r in GROUPS.items()) + """) AS g(g, r)),
cut AS (SELECT word, g, r, string_split(word, g) AS parts FROM words JOIN grp ON contains(word, g)),
made AS (SELECT word, g, r, parts, 1 AS i, parts[1] AS v FROM cut
  UNION ALL SELECT word, g, r, parts, i + 1, v || x || parts[i + 1] FROM (SELECT *, unnest([g, r]) AS x FROM made WHERE i < len(parts))),
variant AS MATERIALIZED (SELECT DISTINCT word, g, v FROM made WHERE i = len(parts) AND v <> word),
asked AS MATERIALIZED (SELECT word FROM words UNION SELECT v FROM variant),
"""


@query(
    SEARCH + VARIANTS + BEAMS.rstrip() + f""", every AS (SELECT w.word, r.candidate, r.p FROM words w JOIN reading r ON r.word = w.word UNION ALL SELECT v.word, r.candidate, r.p FROM variant v JOIN reading r ON r.word = v.v)
SELECT word, k::INTEGER AS k, candidate, {LOG} FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY p DESC, candidate) AS k FROM every) WHERE k <= 4"""
)
def kbest_multichar(spark, sf_dir):
    return _candidates(hmm.kbest_words(_words(spark, sf_dir).select(F.col("original").alias("word")), _model(spark, sf_dir), multichars=GROUPS))


@query(
    SEARCH + ASKED + """pre AS MATERIALIZED (SELECT DISTINCT left(word, i) AS pre, left(word, i - 1) AS parent, substr(word, i, 1) AS ch, i AS n FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM asked)),
path AS (SELECT x.pre, x.n, i.i, i.ch AS txt, i.p * coalesce(e.p, 0) AS p FROM pre x JOIN pi i ON true LEFT JOIN pe e ON e.state = i.ch AND e.obs = x.ch WHERE x.n = 1
  UNION ALL SELECT y.pre, y.n, y.di, y.best.txt || y.dst, y.best.p * coalesce(e.p, 0) FROM (
    SELECT x.pre, x.n, x.ch, t.di, t.dst, max({'p': b.p * t.p, 'first': -b.i, 'txt': b.txt}) AS best FROM path b JOIN pre x ON x.parent = b.pre AND x.n = b.n + 1 JOIN pt t ON t.si = b.i GROUP BY ALL) y
    LEFT JOIN pe e ON e.state = y.dst AND e.obs = y.ch),
last AS (SELECT pre, max({'p': p, 'first': -i, 'txt': txt}) AS best FROM path GROUP BY pre)
SELECT a.word, CASE WHEN a.word = '' THEN '' ELSE best.txt END AS reading FROM asked a LEFT JOIN last ON last.pre = a.word"""
)
def viterbi(spark, sf_dir):
    return hmm.viterbi_words(_words(spark, sf_dir).select(F.col("original").alias("word")), _model(spark, sf_dir))


APPLIED = f"""WITH {TOK}, marked AS (SELECT *, coalesce(original, '') || '#' || doc_index AS word, coalesce(nullif(gold, ''), original, '') || '#' || doc_index AS meant, NOT is_discarded AS there FROM tok),
l AS (SELECT doc_id, doc_index, word, there AND word = meant AS same FROM marked),
r AS (SELECT doc_id, 2 * doc_index AS place, meant, word = meant AS same FROM marked WHERE there UNION ALL SELECT doc_id, 2 * doc_index + 1, meant || '+', false FROM marked WHERE there AND doc_index % 50 = 0),
lg AS (SELECT *, count(*) FILTER (same) OVER (PARTITION BY doc_id ORDER BY doc_index) AS grp FROM l),
rg AS (SELECT *, count(*) FILTER (same) OVER (PARTITION BY doc_id ORDER BY place) AS grp FROM r),
ln AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY doc_index) AS n FROM lg WHERE NOT same),
rn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY place) AS n FROM rg WHERE NOT same),
sizes AS (SELECT doc_id, grp, count(*) AS size FROM rn GROUP BY ALL)
SELECT doc_id, doc_index, word AS original, word AS gold, false AS is_discarded FROM l WHERE same
UNION ALL SELECT ln.doc_id, ln.doc_index, ln.word, CASE WHEN size IS NULL THEN '' ELSE rn.meant END, size IS NULL FROM ln LEFT JOIN rn USING (doc_id, grp, n) LEFT JOIN sizes ON sizes.doc_id = ln.doc_id AND sizes.grp = ln.grp"""


@query(APPLIED)
def apply_as_gold(spark, sf_dir):
    """The corrected sequence of each document, without its discarded rows and with a row put in behind
    every fiftieth, taken over as gold of the one read. Each word carries its number, which makes the
    expected alignment one that SQL can state."""
    t = _tokens(spark, sf_dir)
    number = lambda c: F.concat(F.coalesce(c, F.lit("")), F.lit("#"), F.col("doc_index"))
    left = t.select("doc_id", "doc_index", number(F.col("original")).alias("original"))
    meant = t.where("NOT is_discarded").select("doc_id", "doc_index", number(X.effective(F.col("gold"), F.col("original"))).alias("original"))
    more = meant.where("doc_index % 50 = 0").select("doc_id", (F.col("doc_index") * 2 + 1).alias("doc_index"), F.concat("original", F.lit("+")).alias("original"))
    right = meant.withColumn("doc_index", F.col("doc_index") * 2).unionByName(more)
    return align.apply_as_gold(left, right, strict=False)


# ---------------------------------------------------------------------------------------------
# Decisions

BINS = f"""WITH {TOK}, {KB}, {DICT},
kl AS (SELECT doc_id, doc_index, list(candidate ORDER BY k) AS cand, list(k ORDER BY k) FILTER ({known_sql('candidate')}) AS hits, list(candidate ORDER BY k) FILTER (k > 1 AND {known_sql('candidate')}) AS lower_hits FROM kb GROUP BY ALL),
know AS (SELECT t.*, {known_sql('t.original')} AS o, kl.cand, coalesce(kl.hits, []) AS hits, coalesce(kl.lower_hits, []) AS lower_hits, kl.cand[1] AS k1, t.original IS NOT DISTINCT FROM kl.cand[1] AS same FROM tok t LEFT JOIN kl USING (doc_id, doc_index)),
num AS (SELECT * EXCLUDE (bin, heuristic, selection), bin AS old_bin, CASE WHEN cand IS NULL THEN 10 WHEN same AND o THEN 1 WHEN same AND len(hits) = 0 THEN 2 WHEN same THEN 3 WHEN NOT o AND list_contains(hits, 1) THEN 4 WHEN NOT o AND len(hits) = 0 THEN 5
  WHEN NOT o THEN 6 WHEN list_contains(hits, 1) THEN 7 WHEN len(hits) = 0 THEN 8 ELSE 9 END AS bin FROM know),
setting AS (SELECT g.i AS bin, coalesce(max(s.heuristic), 'annotator') AS heuristic FROM generate_series(1, 10) AS g(i) LEFT JOIN bin_settings s ON s.bin = g.i GROUP BY g.i),
dec AS (SELECT n.*, s.heuristic, CASE s.heuristic WHEN 'original' THEN original WHEN 'kbest' THEN '1' WHEN 'kdict' THEN hits[1]::VARCHAR ELSE '[' || array_to_string(hits, ', ') || ']' END AS selection FROM num n JOIN setting s ON s.bin = n.bin),
able AS (SELECT *, is_hyphenated AND NOT is_discarded AS able FROM dec), {PAIRED},
moved AS (SELECT *, lag(bin) OVER w AS pb, lag(heuristic) OVER w AS ph, lag(selection) OVER w AS ps FROM pair WINDOW w AS (PARTITION BY doc_id ORDER BY doc_index)),
binned AS (SELECT doc_id, doc_index, original, gold, cand, k1, hits, lower_hits, old_bin, is_hyphenated, is_discarded, CASE WHEN consumed THEN pb ELSE bin END AS bin, CASE WHEN consumed THEN ph ELSE heuristic END AS heuristic, CASE WHEN consumed THEN ps ELSE selection END AS selection FROM moved)
"""


def _binned(spark, sf_dir):
    # read by several branches of the plan: written once
    tokens = stage_table(_tokens(spark, sf_dir).drop("token_type", "token_info", "annotations", "last_modified"), "tokens")
    known = stage_table(bins.looked_up(tokens, _kbest(spark, sf_dir), _dictionary(spark, sf_dir)), "candidates")
    return bins.bin_tokens(known, _dictionary(spark, sf_dir), read_table(spark, sf_dir, "bin_settings"))


@query(BINS + "SELECT doc_id, doc_index, bin, heuristic, selection FROM binned")
def bin_tokens(spark, sf_dir):
    return _binned(spark, sf_dir).select("doc_id", "doc_index", "bin", "heuristic", "selection")


@query(BINS + "SELECT bin, heuristic, count(*) AS n_tokens, count(*) FILTER (heuristic = 'annotator') AS n_annotator FROM binned GROUP BY ALL")
def bin_histogram(spark, sf_dir):
    return bins.histogram(_binned(spark, sf_dir))


@query(
    BINS + "SELECT doc_id, doc_index, CASE WHEN gold <> '' THEN gold ELSE coalesce(CASE WHEN heuristic = 'original' THEN original WHEN heuristic IN ('kbest', 'kdict') AND TRY_CAST(selection AS INTEGER) IS NOT NULL THEN coalesce(cand[TRY_CAST(selection AS INTEGER)], '') END, gold) END AS gold FROM binned"
)
def autocorrect(spark, sf_dir):
    return bins.autocorrect(_binned(spark, sf_dir))


@query(BINS + "SELECT doc_id, count(*) FILTER (heuristic = 'annotator') AS n_annotator, count(*) AS n_tokens FROM binned GROUP BY doc_id")
def annotator_load(spark, sf_dir):
    return _binned(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("heuristic") == "annotator").alias("n_annotator"), F.count("*").alias("n_tokens"))


CLASS = "CASE WHEN original IS NULL OR (original = '' AND gold IS NULL) THEN 'malformed' WHEN regexp_full_match(original, '\\p{P}+') THEN 'punctuation' WHEN original = '' AND gold <> '' THEN 'undersegmented' WHEN gold = '' AND original <> '' THEN 'oversegmented' WHEN gold IS NULL OR gold = '' THEN 'nogold' ELSE 'counted' END"


@query(
    f"WITH {TOK}, c AS (SELECT *, {CLASS} AS class FROM tok) SELECT count(*) AS total, count(*) FILTER (is_hyphenated) AS hyphenated, "
    + ", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in ("punctuation", "undersegmented", "oversegmented", "nogold", "malformed"))
    + ", count(*) FILTER (class IN ('nogold', 'counted')) AS token_count FROM c"
)
def report_totals(spark, sf_dir):
    return report.totals(_tokens(spark, sf_dir))


@query(
    f"WITH {CONS}, {COUNTED}, {HELD}, c AS (SELECT *, {CLASS} AS class FROM tok WHERE doc_id IN (SELECT doc_id FROM held WHERE is_done UNION SELECT doc_id FROM stats WHERE done)) SELECT count(*) AS total, count(*) FILTER (is_hyphenated) AS hyphenated, "
    + ", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in ("punctuation", "undersegmented", "oversegmented", "nogold", "malformed"))
    + ", count(*) FILTER (class IN ('nogold', 'counted')) AS token_count FROM c"
)
def report_totals_finished(spark, sf_dir):
    """The same over finished documents only."""
    return report.totals(views.tokens_of(_tokens(spark, sf_dir), _finished(spark, sf_dir)))


@query(f"WITH {CONS}, {COUNTED}, {HELD} SELECT original, gold, count(*) AS n FROM cons WHERE original IS NOT NULL AND gold IS NOT NULL AND doc_id IN (SELECT doc_id FROM held WHERE is_done UNION SELECT doc_id FROM stats WHERE done) GROUP BY ALL")
def alignments_finished(spark, sf_dir):
    """Aligned pairs of words of finished documents only."""
    return align.full_alignments(T.consolidated(views.tokens_of(_tokens(spark, sf_dir), _finished(spark, sf_dir))))


REPORT = BINS.rstrip() + f""", r AS (SELECT *, coalesce(gold = original, false) AS same, coalesce(gold = k1, false) AS top, coalesce(list_contains(lower_hits, gold), false) AS low, heuristic = 'annotator' AS hand FROM (SELECT *, {CLASS} AS class FROM binned) WHERE class IN ('nogold', 'counted') AND bin IS NOT NULL),
rb AS (SELECT bin, count(*) AS total, count(*) FILTER (same) AS gold_is_original, count(*) FILTER (top) AS gold_is_top, count(*) FILTER (low) AS gold_is_lower, {", ".join(f"count(*) FILTER (heuristic = '{h}') AS by_{h}" for h in ("original", "kbest", "kdict", "annotator"))},
  count(*) FILTER (hand AND same) AS annotator_original, count(*) FILTER (hand AND NOT same AND top) AS annotator_top, count(*) FILTER (hand AND NOT same AND NOT top AND low) AS annotator_lower, count(*) FILTER (hand AND NOT same AND NOT top AND NOT low AND gold IS NOT NULL) AS annotator_novel FROM r GROUP BY bin)
"""


@query(REPORT + "SELECT * FROM rb")
def report_bins(spark, sf_dir):
    return report.per_bin(_binned(spark, sf_dir))


@query(REPORT + "SELECT name, sum(n)::BIGINT AS n FROM (UNPIVOT rb ON COLUMNS(* EXCLUDE bin) INTO NAME name VALUE n) GROUP BY name")
def report_summary(spark, sf_dir):
    return report.summary(report.per_bin(_binned(spark, sf_dir)))


@query(BINS + "SELECT old_bin, bin AS new_bin, count(*) AS n FROM binned GROUP BY ALL")
def rebin_moves(spark, sf_dir):
    return report.rebin_moves(_tokens(spark, sf_dir), _binned(spark, sf_dir))


@query(BINS + f"SELECT bin, doc_id, doc_index, original FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY doc_id, doc_index) AS rn FROM binned WHERE length(original) > 3 AND {letters_sql('original')} > 0 AND bin IS NOT NULL) WHERE rn = 1")
def first_examples(spark, sf_dir):
    return report.first_examples(_binned(spark, sf_dir))


@query(f"WITH {TOK} SELECT original, gold, count(*) AS n FROM tok WHERE original IS NOT NULL AND gold IS NOT NULL GROUP BY ALL")
def correction_tracking(spark, sf_dir):
    return report.by_count(report.tracked(_tokens(spark, sf_dir)))


@query(f"WITH {TOK}, c AS (SELECT original, gold, count(*) AS n FROM tok WHERE original IS NOT NULL AND gold IS NOT NULL GROUP BY ALL) SELECT original, gold FROM (SELECT *, row_number() OVER (PARTITION BY original ORDER BY n DESC, gold DESC) AS rn FROM c) WHERE rn = 1")
def memoized(spark, sf_dir):
    return report.memoized(report.tracked(_tokens(spark, sf_dir)))


@query(f"WITH {TOK}, c AS (SELECT original, gold, count(*) AS n FROM tok WHERE original IS NOT NULL AND gold IS NOT NULL GROUP BY ALL) SELECT original, gold FROM (SELECT *, row_number() OVER (PARTITION BY original ORDER BY n, gold DESC) AS rn FROM c) WHERE rn = 1")
def memoized_least(spark, sf_dir):
    return report.memoized(report.tracked(_tokens(spark, sf_dir)), least_frequent=True)


# ---------------------------------------------------------------------------------------------
# Joins, upserts, events, index


@query(f"WITH {TOK}, {KB} SELECT t.doc_id, t.doc_index, t.original, string_agg(kb.candidate, '|' ORDER BY kb.k) AS candidates, count(kb.k)::INTEGER AS n_candidates FROM tok t LEFT JOIN kb USING (doc_id, doc_index) GROUP BY t.doc_id, t.doc_index, t.original")
def kbest_join(spark, sf_dir):
    t = T.with_candidates(_tokens(spark, sf_dir), _kbest(spark, sf_dir))
    joined = F.array_join("kbest.candidate", "|")
    return t.select("doc_id", "doc_index", "original", F.when(F.size("kbest") > 0, joined).alias("candidates"), F.size("kbest").alias("n_candidates"))


@query(f"WITH {TOK} SELECT * FROM tok")
def upsert_latest(spark, sf_dir):
    return _tokens(spark, sf_dir)


EVENTS = f"""{TOK}, numbered_tok AS (SELECT doc_id, doc_index, original, (coalesce(TRY_CAST(nullif(regexp_extract(doc_id, '([0-9]{{1,9}})$', 1), '') AS BIGINT), 0) * 31 + doc_index) % (SELECT count(*) FROM events) AS r FROM tok),
ev AS (SELECT event_id, doc_id, doc_index, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'gold' WHEN 'view' THEN 'hyphenate-right' WHEN 'purchase' THEN 'hyphenate-left' ELSE 'discard' END AS action,
  CASE event_type WHEN 'click' THEN original || '!' WHEN 'view' THEN 'ti-me' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'ti-me' ELSE 'time' END END AS gold, ts AS made_at
  FROM events JOIN numbered_tok ON r = event_id),
upd AS (
  SELECT doc_id, doc_index, event_id, made_at, gold AS set_gold, NULL::BOOLEAN AS set_hyphenated, NULL::BOOLEAN AS set_discarded, NULL::BOOLEAN AS set_error FROM ev WHERE action = 'gold'
  UNION ALL SELECT doc_id, doc_index, event_id, made_at, NULL, NULL, NULL, true FROM ev WHERE action = 'error'
  UNION ALL SELECT doc_id, doc_index, event_id, made_at, '', NULL, true, NULL FROM ev WHERE action = 'discard'
  UNION ALL SELECT doc_id, doc_index - (CASE action WHEN 'hyphenate-left' THEN 1 ELSE 0 END), event_id, made_at, split_part(gold, '-', 1) || chr(173), true, NULL, NULL FROM ev WHERE action LIKE 'hyphenate%' AND len(string_split(gold, '-')) = 2
  UNION ALL SELECT doc_id, doc_index + (CASE action WHEN 'hyphenate-left' THEN 0 ELSE 1 END), event_id, made_at, split_part(gold, '-', 2), NULL, NULL, NULL FROM ev WHERE action LIKE 'hyphenate%' AND len(string_split(gold, '-')) = 2),
red AS (SELECT doc_id, doc_index, {", ".join(f"arg_max(set_{c}, (made_at, event_id)) FILTER (set_{c} IS NOT NULL) AS set_{c}" for c in ("gold", "hyphenated", "discarded", "error"))}, max(made_at) AS made_at, count(*) AS n_updates FROM upd GROUP BY doc_id, doc_index)"""


def _events(spark, sf_dir):
    """Annotators' requests made from the event stream: every token gets the event whose number its
    document's number and its own place give."""
    e = read_table(spark, sf_dir, "events")
    number = F.coalesce(F.regexp_extract("doc_id", "([0-9]{1,9})$", 1).try_cast("long"), F.lit(0)) * 31 + F.col("doc_index")
    numbered = _tokens(spark, sf_dir).select("doc_id", "doc_index", "original", (number % max(1, e.count())).alias("event_id"))
    kind = F.col("event_type")
    action = F.when(kind == "error", "error").when(kind == "click", "gold").when(kind == "view", "hyphenate-right").when(kind == "purchase", "hyphenate-left").otherwise("discard")
    odd = F.when(F.col("event_id") % 2 == 0, "ti-me").otherwise("time")
    gold = F.when(kind == "click", F.concat("original", F.lit("!"))).when(kind == "view", "ti-me").when(kind == "purchase", odd)
    return e.join(numbered, "event_id").select("event_id", "doc_id", "doc_index", action.alias("action"), gold.alias("gold"), F.col("ts").alias("made_at"))


@query(f"WITH {EVENTS} SELECT doc_id, doc_index, event_id, made_at, set_gold, set_hyphenated, set_discarded, set_error FROM upd")
def hyphenate_events(spark, sf_dir):
    """What every request does to the rows it names; a hyphenation touches two."""
    return annotate.row_updates(_events(spark, sf_dir))


@query(
    f"WITH {EVENTS} SELECT t.doc_id, t.doc_index, coalesce(set_gold, gold) AS gold, coalesce(set_hyphenated, is_hyphenated) AS is_hyphenated, coalesce(set_discarded, is_discarded) AS is_discarded, coalesce(set_error, has_error) AS has_error, r.made_at AS last_modified FROM tok t JOIN red r USING (doc_id, doc_index)"
)
def annotation_updates(spark, sf_dir):
    reduced = annotate.reduce_updates(annotate.row_updates(_events(spark, sf_dir)))
    return annotate.touched_rows(_tokens(spark, sf_dir), reduced).select("doc_id", "doc_index", "gold", "is_hyphenated", "is_discarded", "has_error", "last_modified")


KEY = f"trim(trim(lower(word), '{PUNCT}'), {ASCII_BLANK})"
INDEX = f"""WITH {CONS}, word AS (SELECT doc_id, doc_index, coalesce(nullif(gold, ''), original) AS word FROM cons),
term AS (SELECT DISTINCT group_name AS tag, {KEY} AS term FROM dict_words WHERE group_name IN ('places', 'annotator_gold')),
tags AS (SELECT term, list(tag ORDER BY tag) AS tags FROM term WHERE term <> '' GROUP BY term),
seq AS (SELECT w.doc_id, w.doc_index, w.word, t.tags FROM word w LEFT JOIN tags t ON {KEY} = t.term),
num2 AS (SELECT *, sum(CASE WHEN tags IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY doc_index) AS run FROM seq),
runs AS (SELECT doc_id, run, min(doc_index) AS first_index, max(doc_index) AS last_index, string_agg(word, ' ' ORDER BY doc_index) AS tokens, string_agg(array_to_string(tags, '+'), ' ' ORDER BY doc_index) AS tags, count(*) AS n FROM num2 WHERE tags IS NOT NULL GROUP BY doc_id, run)
"""


def _tagged(spark, sf_dir):
    raw = read_table(spark, sf_dir, "dict_words").where("group_name IN ('places', 'annotator_gold')").select(F.col("group_name").alias("tag"), F.col("word").alias("term"))
    return index.tagged(_tokens(spark, sf_dir), index.terms(raw))


@query(INDEX + "SELECT doc_id, doc_index, word, array_to_string(tags, '+') AS tags FROM seq WHERE tags IS NOT NULL")
def tagged_tokens(spark, sf_dir):
    return _tagged(spark, sf_dir).where("tags IS NOT NULL").select("doc_id", "doc_index", "word", F.array_join("tags", "+").alias("tags"))


@query(INDEX + "SELECT doc_id, first_index, last_index, tokens, tags FROM runs WHERE n > 1")
def term_index(spark, sf_dir):
    return index.runs(_tagged(spark, sf_dir))


@query(f"{INDEX.rstrip()}, {BOX.replace(TOK + ', ', '')} SELECT b.doc_id, b.doc_index, b.page, x0, y0, x1, y1, r.tags FROM runs r JOIN boxes b ON b.doc_id = r.doc_id AND b.doc_index BETWEEN r.first_index AND r.last_index WHERE r.n > 1")
def index_highlights(spark, sf_dir):
    return index.highlights(index.runs(_tagged(spark, sf_dir)), _boxes(spark, sf_dir)).select("doc_id", "doc_index", "page", "x0", "y0", "x1", "y1", "tags")
