"""Token sequences: current rows, pairing of broken words, rendering, statistics.

Order inside a document matters, and one document may hold a large share of all rows. So no window
here spans a whole document: rows are windowed in key ranges of ``2**RANGE_BITS`` indexes, and what
crosses a range is carried by a summary with one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X

RANGE_BITS = 12


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert by primary key: of all rows of a key the one greatest in ``order`` (NULL lowest), then
    in the other columns; aggregated before and after one shuffle, never sorted."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in [*order, *rest]])


TOKEN_COLUMNS = ("original", "gold", "hyphenated", "discarded", "has_error", "bin", "heuristic", "selection", "token_type", "token_info", "annotations")


def current(delivered: DataFrame) -> DataFrame:
    """The token table proper: the last version of every token, flags without NULL, unbinned as NULL."""
    keyed = delivered.where("doc_id IS NOT NULL AND doc_index IS NOT NULL").select("doc_id", "doc_index", "last_modified", "loaded_at", *TOKEN_COLUMNS)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return latest(keyed, ["doc_id", "doc_index"], ["last_modified", "loaded_at"]).select(
        "doc_id",
        "doc_index",
        "original",
        "gold",
        flag("hyphenated").alias("is_hyphenated"),
        flag("discarded").alias("is_discarded"),
        flag("has_error").alias("has_error"),
        F.when(F.col("bin") > 0, F.col("bin")).alias("bin"),
        "heuristic",
        "selection",
        "token_type",
        "token_info",
        "annotations",
        "last_modified",
    )


def candidates(delivered: DataFrame) -> DataFrame:
    """The k-best table proper: the last row of every ``(doc_id, doc_index, k)``."""
    keyed = delivered.where("doc_id IS NOT NULL AND doc_index IS NOT NULL AND k IS NOT NULL").select("doc_id", "doc_index", "k", "loaded_at", "candidate", F.col("probability").cast("double").alias("probability"))
    return latest(keyed, ["doc_id", "doc_index", "k"], ["loaded_at"]).drop("loaded_at")


def with_candidates(tokens: DataFrame, kbest: DataFrame) -> DataFrame:
    """Adds ``kbest``, the candidates in order of k as an array of structs; empty where there are none."""
    lists = kbest.groupBy("doc_id", "doc_index").agg(F.array_sort(F.collect_list(F.struct("k", "candidate", "probability"))).alias("kbest"))
    return tokens.join(lists, ["doc_id", "doc_index"], "left").withColumn("kbest", F.coalesce("kbest", F.array().cast("array<struct<k:int,candidate:string,probability:double>>")))


def tokenize(documents: DataFrame, header_lines: int = 0) -> DataFrame:
    """``(doc_id, doc_index, original)`` of running texts, split at Unicode white space; the first
    ``header_lines`` lines are left out."""
    body = F.col("text")
    if header_lines:
        body = F.array_join(F.slice(F.split(body, "\n"), header_lines + 1, 1 << 30), "\n")
    return documents.select("doc_id", F.posexplode(X.split_words(body)).alias("doc_index", "original"))


# ---------------------------------------------------------------------------------------------
# Neighbours


def _range() -> Column:
    return F.shiftright("doc_index", RANGE_BITS).alias("rng")


def with_neighbours(tokens: DataFrame, ahead: list[str] = (), behind: list[str] = ()) -> DataFrame:
    """Adds ``next_<c>`` and ``prev_<c>``: columns of the next and previous row of the document."""
    rows = tokens.withColumn("rng", _range())
    w = Window.partitionBy("doc_id", "rng").orderBy("doc_index")
    over = Window.partitionBy("doc_id").orderBy("rng")
    first, last = F.struct(*ahead, F.lit(1).alias("there")), F.struct(*behind, F.lit(1).alias("there"))
    edges = rows.groupBy("doc_id", "rng").agg(F.min_by(first, "doc_index").alias("f"), F.max_by(last, "doc_index").alias("l"))
    edges = edges.select("doc_id", "rng", F.lead("f").over(over).alias("after"), F.lag("l").over(over).alias("before"))
    out = rows.withColumns({"n": F.lead(first).over(w), "p": F.lag(last).over(w)}).join(edges, ["doc_id", "rng"])
    out = out.withColumns({"n": F.coalesce("n", "after"), "p": F.coalesce("p", "before")})
    return out.select(*tokens.columns, *[F.col("n")[c].alias(f"next_{c}") for c in ahead], *[F.col("p")[c].alias(f"prev_{c}") for c in behind])


def with_pairs(tokens: DataFrame, eligible: Column, ahead: list[str] = ()) -> DataFrame:
    """Greedy pairing from left to right: adds ``head`` (takes the next row) and ``consumed`` (is
    taken by the row before), and ``next_<c>`` columns.

    A row is consumed exactly if the number of eligible rows in an unbroken run directly before it
    is odd, so its place after the last row not eligible decides. That place is carried over key
    ranges by a running maximum in the summary.
    """
    rows = tokens.withColumns({"rng": _range(), "able": F.coalesce(eligible, F.lit(False))})
    w = Window.partitionBy("doc_id", "rng").orderBy("doc_index")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("rn", F.row_number().over(w)).withColumn("stop", F.max(F.when(~F.col("able"), F.col("rn"))).over(before))
    first = F.struct(*ahead, F.lit(1).alias("there"))
    numbered = numbered.withColumn("n", F.lead(first).over(w))
    over = Window.partitionBy("doc_id").orderBy("rng")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    edges = numbered.groupBy("doc_id", "rng").agg(F.count("*").alias("size"), F.max(F.when(~F.col("able"), F.col("rn"))).alias("halt"), F.min_by(first, "doc_index").alias("f"))
    edges = edges.withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    edges = edges.select("doc_id", "rng", "base", F.max(F.col("base") + F.col("halt")).over(earlier).alias("carried"), F.lead("f").over(over).alias("after"))
    place = F.col("base") + F.col("rn") - 1
    stop = F.coalesce(F.col("base") + F.col("stop"), F.col("carried"), F.lit(0))
    out = numbered.join(edges, ["doc_id", "rng"]).withColumn("consumed", (place - stop) % 2 == 1)
    out = out.withColumns({"head": F.col("able") & ~F.col("consumed"), "n": F.coalesce("n", "after")})
    return out.select(*tokens.columns, "head", "consumed", *[F.col("n")[c].alias(f"next_{c}") for c in ahead])


# ---------------------------------------------------------------------------------------------
# Views of the sequence


def overview(tokens: DataFrame) -> DataFrame:
    return tokens.select(
        "doc_id",
        "doc_index",
        X.effective(F.col("gold"), F.col("original")).alias("string"),
        F.col("gold").isNotNull().alias("is_corrected"),
        "is_discarded",
        F.col("heuristic").eqNullSafe("annotator").alias("requires_annotator"),
        "has_error",
        F.unix_timestamp(F.col("last_modified").cast("timestamp")).alias("last_modified_s"),
    )


def consolidated(tokens: DataFrame) -> DataFrame:
    """The sequence with broken words joined: a head takes the next row's text and gold; discarded
    and consumed rows are gone; without a next row a head is closed by a hyphen."""
    able = F.col("is_hyphenated") & ~F.col("is_discarded")
    pairs = with_pairs(tokens, able, ["original", "gold", "doc_index"])
    last = F.col("next_doc_index").isNull()
    original = F.when(F.col("head"), F.concat("original", F.when(last, F.lit("-")).otherwise(F.col("next_original")))).otherwise(F.col("original"))
    gold = F.when(F.col("head") & (F.col("gold") != ""), F.concat("gold", F.when(last, F.lit("-")).otherwise(F.col("next_gold")))).otherwise(F.col("gold"))
    return pairs.where("NOT consumed AND NOT is_discarded").select("doc_id", "doc_index", original.alias("original"), gold.alias("gold"), F.col("head").alias("is_joined"), "heuristic", "bin", "selection")


def rendered_words(tokens: DataFrame) -> DataFrame:
    """``(doc_id, doc_index, word)`` as printed: heads lose their last character and take the next text."""
    t = tokens.withColumn("shown", X.effective(F.col("gold"), F.col("original")))
    pairs = with_pairs(t, F.col("is_hyphenated"), ["shown", "doc_index"])
    cut = F.expr("left(shown, length(shown) - 1)")
    word = F.when(F.col("head") & F.col("next_doc_index").isNotNull(), F.concat(cut, "next_shown")).when(F.col("head"), F.concat(cut, F.lit("-"))).otherwise(F.col("shown"))
    return pairs.where("NOT consumed").select("doc_id", "doc_index", word.alias("word"))


def render(tokens: DataFrame) -> DataFrame:
    """``(doc_id, piece, text)``: the printed text, one piece per key range of the document."""
    words = rendered_words(tokens).withColumn("piece", _range())
    ordered = F.array_sort(F.collect_list(F.struct("doc_index", "word")))
    return words.groupBy("doc_id", "piece").agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("text"))


def document_texts(tokens: DataFrame) -> DataFrame:
    """``(doc_id, text)``: the printed text of each document as one value, put together from its pieces.
    A document has to fit into a value here; ``sources.files.write_documents`` writes any."""
    pieces = F.array_sort(F.collect_list(F.struct("piece", "text")))
    return render(tokens).groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), " ").alias("text"))


def lookup(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """The tokens asked for by ``(doc_id, doc_index)``, with ``status``: 200, or 404 and no values where
    there is no such document or token."""
    asked = keys.select("doc_id", "doc_index").distinct()
    found = asked.join(tokens.withColumn("there", F.lit(True)), ["doc_id", "doc_index"], "left")
    return found.withColumn("status", F.when(F.col("there"), 200).otherwise(404)).drop("there")


def in_order(tokens: DataFrame) -> DataFrame:
    """Tokens by document and place, as they are listed."""
    return tokens.orderBy("doc_id", "doc_index")


def text_sink_form(text: Column) -> Column:
    """Written form of a corrected text: line marks become line ends, the header says corrected."""
    t = F.replace(text, F.lit("_NEWLINE_N_"), F.lit("\n"))
    return F.replace(F.replace(t, F.lit(" \n "), F.lit("\n")), F.lit("Corrected: No"), F.lit("Corrected: Yes"))


def dehyphenate(tokens: DataFrame) -> DataFrame:
    """Flags heads that end in a hyphen and empties the gold of the row each takes."""
    pairs = with_pairs(tokens, X.ends_in_hyphen(F.col("original")))
    return pairs.select(
        "doc_id",
        "doc_index",
        "original",
        (F.col("is_hyphenated") | F.col("head")).alias("is_hyphenated"),
        F.when(F.col("consumed"), F.lit("")).otherwise(F.col("gold")).alias("gold"),
    )


def doc_stats(tokens: DataFrame) -> DataFrame:
    """Counts per document over the paired sequence, with the completion rule and the checks."""
    pairs = with_pairs(tokens, F.col("is_hyphenated") & ~F.col("is_discarded"))
    seen = ~F.col("consumed")
    kept = seen & ~F.col("is_discarded")
    fixed = kept & ~F.col("has_error") & F.col("gold").isNotNull()
    by_hand = F.col("heuristic").eqNullSafe("annotator")
    stats = pairs.groupBy("doc_id").agg(
        F.count("*").alias("index_count"),
        F.count_if(seen & F.col("is_discarded")).alias("discarded_count"),
        F.count_if(kept).alias("token_count"),
        F.count_if(kept & F.col("is_hyphenated")).alias("hyphenated_count"),
        F.count_if(kept & F.col("has_error")).alias("error_count"),
        F.count_if(kept & ~F.col("has_error") & F.col("gold").isNull()).alias("uncorrected_count"),
        F.count_if(fixed).alias("corrected_count"),
        F.count_if(fixed & by_hand).alias("corrected_by_annotator_count"),
        F.count_if(fixed & ~by_hand).alias("corrected_by_model_count"),
        F.count_if(fixed & (F.col("gold") == "")).alias("empty_gold_count"),
    )
    return stats.withColumn("done", (F.col("token_count") > 0) & (F.col("corrected_count") == F.col("token_count")) & (F.col("error_count") == 0))


def validate_stats(stats: DataFrame) -> DataFrame:
    """The equations the counts must fulfil, as columns."""
    return stats.select(
        "doc_id",
        (F.col("corrected_count") == F.col("corrected_by_annotator_count") + F.col("corrected_by_model_count")).alias("parts_add_up"),
        (F.col("token_count") == F.col("corrected_count") + F.col("uncorrected_count")).alias("tokens_add_up"),
        (F.col("index_count") == F.col("token_count") + F.col("hyphenated_count") + F.col("discarded_count")).alias("rows_add_up"),
        (F.col("error_count") == 0).alias("no_errors"),
        "done",
    )


def server_ready(tokens: DataFrame) -> DataFrame:
    """Ready: no kept row without heuristic; the strict form also forbids discarded rows."""
    return tokens.groupBy("doc_id").agg(
        (F.count_if(F.col("heuristic").isNull() & ~F.col("is_discarded")) == 0).alias("ready"),
        F.bool_and(F.col("heuristic").isNotNull() & ~F.col("is_discarded")).alias("ready_strict"),
        F.max("last_modified").alias("last_modified"),
        F.max("doc_index").alias("max_index"),
    )


def context(tokens: DataFrame, wanted: Column, before: int = 7, after: int = 7) -> DataFrame:
    """The words around wanted rows. The rows of a range also go to the neighbouring ranges as far
    as the frame may reach, by their place in the document, not by index."""
    rows = tokens.select("doc_id", "doc_index", "original", F.coalesce(wanted, F.lit(False)).alias("wanted"), _range())
    w = Window.partitionBy("doc_id", "rng").orderBy("doc_index")
    over = Window.partitionBy("doc_id").orderBy("rng")
    sizes = rows.groupBy("doc_id", "rng").agg(F.count("*").alias("size"))
    sizes = sizes.select("doc_id", "rng", F.coalesce(F.sum("size").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = rows.withColumn("rn", F.row_number().over(w)).join(sizes, ["doc_id", "rng"]).withColumn("place", F.col("base") + F.col("rn") - 1)
    size = 1 << RANGE_BITS
    home = F.floor(F.col("place") / size)
    inside = F.col("place") % size
    targets = F.array_compact(F.array(home, F.when((inside < after) & (home > 0), home - 1), F.when(inside >= size - before, home + 1)))
    spread = placed.withColumns({"home": home}).withColumn("part", F.explode(targets))
    v = Window.partitionBy("doc_id", "part").orderBy("place")
    return (
        spread.withColumns({"left": F.collect_list("original").over(v.rowsBetween(-before, -1)), "right": F.collect_list("original").over(v.rowsBetween(1, after))})
        .where("wanted AND part = home")
        .select("doc_id", "doc_index", "original", F.array_join("left", " ").alias("left_context"), F.array_join("right", " ").alias("right_context"))
    )


def precache_candidates(tokens: DataFrame) -> DataFrame:
    """Rows whose image an annotator will want: the row or a neighbour goes to the annotator, or the
    row before is hyphenated; kept rows that have both neighbours."""
    t = tokens.withColumn("hand", F.col("heuristic").eqNullSafe("annotator"))
    n = with_neighbours(t, ["hand"], ["hand", "is_hyphenated"])
    need = F.col("hand") | F.col("next_hand") | F.col("prev_hand") | F.col("prev_is_hyphenated")
    return n.where(F.col("next_hand").isNotNull() & F.col("prev_hand").isNotNull() & need & ~F.col("is_discarded")).select("doc_id", "doc_index")


def token_detail(tokens: DataFrame) -> DataFrame:
    """A token as shown to an annotator: joined with the next if hyphenated, soft hyphens shown. With a
    column ``kbest`` its candidates are shown too, their soft hyphens where the token ends in one."""
    n = with_neighbours(tokens, ["original", "gold"], ["is_hyphenated"])
    both = (F.col("gold") != "") & (F.col("next_gold") != "")
    first, corrected = X.shown_hyphen(F.col("original")), X.shown_hyphen(F.col("gold"))
    original = F.when(F.col("is_hyphenated"), F.concat(first, F.coalesce("next_original", F.lit("")))).otherwise(first)
    gold = F.when(F.col("is_hyphenated"), F.when(both, F.concat(corrected, "next_gold"))).otherwise(corrected)
    shown = []
    if "kbest" in tokens.columns:
        soft = F.endswith("original", F.lit("\u00ad"))
        dressed = lambda c: F.struct(c["k"].alias("k"), F.when(soft, F.replace(c["candidate"], F.lit("\u00ad"), F.lit("-"))).otherwise(c["candidate"]).alias("candidate"), c["probability"].alias("probability"))
        # before the select, in which the name ``original`` would mean what is shown
        n = n.withColumn("candidates", F.transform("kbest", dressed))
        shown.append("candidates")
    return n.select(
        "doc_id",
        "doc_index",
        original.alias("original"),
        gold.alias("gold"),
        F.coalesce("prev_is_hyphenated", F.lit(False)).alias("redirects_to_head"),
        F.format_string("/images/%s/%d.png", "doc_id", "doc_index").alias("image_url"),
        *shown,
    )


# ---------------------------------------------------------------------------------------------
# Page geometry


def boxes(tokens: DataFrame) -> DataFrame:
    """``(doc_id, doc_index, page, x0, y0, x1, y1, block, line, word_no)`` from the stored positions
    of both kinds of scans; positions that do not parse give no row; a box that does not is 0."""
    info = F.col("token_info")
    number = lambda k: F.get_json_object(info, f"$[{k}]").try_cast("int")
    pdf = tokens.where("token_type = 'PDFToken' AND token_info LIKE '[%'").select(
        "doc_id", "doc_index", "original", "gold", "is_discarded", number(0).alias("page"), *[number(k).alias(n) for k, n in ((1, "x0"), (2, "y0"), (3, "x1"), (4, "y1"), (6, "block"), (7, "line"), (8, "word_no"))]
    )
    box = F.get_json_object(info, "$.bbox")
    part = lambda k: F.coalesce(F.regexp_extract(box, r"bbox (\d+) (\d+) (\d+) (\d+)", k).try_cast("int"), F.lit(0))
    hocr = tokens.where("token_type = 'HOCRToken' AND token_info LIKE '{%'").select(
        "doc_id", "doc_index", "original", "gold", "is_discarded", F.get_json_object(info, "$.page").try_cast("int").alias("page"), *[part(k).alias(n) for k, n in ((1, "x0"), (2, "y0"), (3, "x1"), (4, "y1"))], F.lit(1).alias("block"), F.get_json_object(info, "$.line").try_cast("int").alias("line"), F.lit(0).alias("word_no")
    )
    return pdf.unionByName(hocr).where("page IS NOT NULL")


def crop_edges(found: DataFrame, tolerance: float = 0.1, edge: int = 20, bins: int = 100) -> DataFrame:
    """Left and right crop edge per page from a histogram of covered columns.

    Edges are those of the outer bins that hold at most ``tolerance`` of the fullest bin: on the
    left the last such bin among the first ``edge``, on the right the last among the last ``edge``.
    A box adds one where it begins and takes one away where it ends; the running sum over these places
    is the cover of the columns between them, so a page costs its distinct edges, not its pixels.
    """
    turns = found.where("x1 > x0").select("doc_id", "page", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))).alias("t"))
    places = turns.groupBy("doc_id", "page", "t.x").agg(F.sum("t.d").alias("d"))
    w = Window.partitionBy("doc_id", "page")  # at most one row per column of pixels
    along = w.orderBy("x")
    runs = places.withColumns({"n": F.sum("d").over(along), "end": F.lead("x").over(along), "lo": F.min("x").over(w), "hi": F.max("x").over(w) - 1}).where("n > 0")
    width = F.col("hi") - F.col("lo")
    number = lambda x: F.when(width == 0, F.lit(bins // 2 + 1)).otherwise(F.least(F.lit(bins), F.floor((x - F.col("lo")) * bins / width).cast("int") + 1))
    parts = runs.withColumn("bin", F.explode(F.sequence(number(F.col("x")), number(F.col("end") - 1))))
    starts = F.col("lo") + F.floor(((F.col("bin") - 1) * width + bins - 1) / bins)
    stops = F.when(F.col("bin") == bins, F.col("hi") + 1).otherwise(F.col("lo") + F.floor((F.col("bin") * width + bins - 1) / bins))
    inside = F.when(width == 0, F.lit(1)).otherwise(F.least("end", stops) - F.greatest("x", starts))
    counts = parts.groupBy("doc_id", "page", "lo", "hi", "bin").agg(F.sum(F.col("n") * inside).alias("n"))
    page = counts.groupBy("doc_id", "page", "lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.max("n").alias("most"))
    low = lambda a, b: F.array_max(F.filter(F.sequence(F.lit(a), F.lit(b)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) <= F.col("most") * tolerance))
    at = lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / bins
    left, right = low(1, edge), low(bins - edge + 1, bins)
    return page.select("doc_id", "page", F.coalesce(F.round(at(left - 1), 6), F.lit(0.0)).alias("left_edge"), F.coalesce(F.round(at(right), 6), F.col("hi") + 1.0).alias("right_edge"))


def outside_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows discarded by cropping: boxes that do not touch the kept area."""
    inside = (F.col("x1") >= F.col("left_edge")) & (F.col("x0") <= F.col("right_edge"))
    return found.join(edges, ["doc_id", "page"]).where(~inside).select("doc_id", "doc_index", "page")


def layout(found: DataFrame, factor: float = 0.71, padding: float = 10.0) -> DataFrame:
    """The rows of the invisible text layer: place, font size and text."""
    shown = X.effective(F.col("gold"), F.col("original"))
    size = F.round((F.col("y1") - F.col("y0")) * factor, 3)
    return (
        found.where(~F.col("is_discarded") & (shown != ""))
        .select("doc_id", "page", "block", "line", "word_no", "doc_index", "x0", "y0", F.greatest(F.col("x1").cast("double"), F.round(F.col("x0") + F.length(shown) * size / 2 + padding, 3)).alias("x1"), "y1", size.alias("font_size"), shown.alias("text"))
    )


def in_page_order(rows: DataFrame) -> DataFrame:
    """Layout rows page by page in the order of block, line and word: whole pages lie in one task each,
    which is how they are written; no sort spans the collection."""
    return rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "block", "line", "word_no", "doc_index")


def snippets(found: DataFrame, left: int = 300, right: int = 300, top: int = 15, bottom: int = 15) -> DataFrame:
    """The rectangle cut from the page image around each word, kept inside the page as far as its words
    tell its size."""
    pages = found.groupBy("doc_id", "page").agg(F.max("x1").alias("width"), F.max("y1").alias("height"))
    return found.join(pages, ["doc_id", "page"]).select(
        "doc_id",
        "doc_index",
        "page",
        F.greatest(F.lit(0), F.col("x0") - left).alias("crop_x0"),
        F.greatest(F.lit(0), F.col("y0") - top).alias("crop_y0"),
        F.least("width", F.col("x1") + right).alias("crop_x1"),
        F.least("height", F.col("y1") + bottom).alias("crop_y1"),
    )


def edges_or(found: DataFrame, left: float | None = None, right: float | None = None) -> DataFrame:
    """Crop edges per page: both given, or computed if neither is; one alone leaves the other side open."""
    if left is None and right is None:
        return crop_edges(found)
    width = F.max("x1") + 1.0
    pages = found.groupBy("doc_id", "page").agg(width.alias("width"))
    return pages.select("doc_id", "page", F.lit(0.0 if left is None else float(left)).alias("left_edge"), (F.col("width") if right is None else F.lit(float(right))).alias("right_edge"))


def cropped(tokens: DataFrame, outside: DataFrame) -> DataFrame:
    """The tokens with those outside the edges discarded, their gold emptied."""
    hit = outside.select("doc_id", "doc_index", F.lit(True).alias("outside"))
    t = tokens.join(hit, ["doc_id", "doc_index"], "left")
    out = F.coalesce("outside", F.lit(False))
    return t.withColumns({"is_discarded": F.col("is_discarded") | out, "gold": F.when(out, F.lit("")).otherwise(F.col("gold"))}).drop("outside")


def renumbered(tokens: DataFrame) -> DataFrame:
    """The rows with ``doc_index`` counted anew from 0 in each document, after rows were taken out or
    put in (a row put in between has a broken number such as 3.5)."""
    rows = tokens.withColumn("rng", F.floor(F.col("doc_index") / (1 << RANGE_BITS)))
    w = Window.partitionBy("doc_id", "rng").orderBy("doc_index")
    over = Window.partitionBy("doc_id").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("doc_id", "rng").agg(F.count("*").alias("size")).select("doc_id", "rng", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("base"))
    numbered = rows.withColumn("rn", F.row_number().over(w)).join(base, ["doc_id", "rng"])
    return numbered.withColumn("doc_index", (F.col("base") + F.col("rn") - 1).cast("int")).select(*tokens.columns)


RECORD = "doc_id string, doc_index int, original string, gold string, is_hyphenated boolean, is_discarded boolean, has_error boolean, bin int, heuristic string, selection string, token_type string, token_info string, annotations string, last_modified timestamp_ntz"


def to_records(tokens: DataFrame) -> DataFrame:
    """Each token as one JSON record, NULL fields included."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    return tokens.select("doc_id", "doc_index", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("record"))


def from_records(records: DataFrame) -> DataFrame:
    return records.select(F.from_json("record", RECORD).alias("t")).select("t.*")
