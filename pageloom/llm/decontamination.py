"""Benchmark decontamination: a hash set of normalised test n-grams against training token windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import ASCII_LOWER, ASCII_UPPER, written

WINDOW = 10
#: Up to so many different windows of bounded text the set goes to every task; beyond, windows are joined by a shuffle.
SET_WINDOWS, SET_BYTES = 50_000, 8 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() does the same, faster, where a text is ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """Runs of digits, letters and anything outside ASCII, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.coalesce(lowered(text), F.lit("")), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, m, items): each different window of an item's words, its length and the ids of the items that have it.

    An item of fewer words than a window is one window; items without words have none. A null item_id is in no list,
    but its windows count.
    """
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text").cast("string")).alias("w"))
    w = w.where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = w.select("item", "w", F.explode(starts).alias("i"))
    each = each.select("item", F.expr(f"array_join(slice(w, i + 1, {window}), ' ')").alias("win"), F.expr(f"xxhash64(slice(w, i + 1, {window}))").alias("h"), F.expr(f"least(size(w), {window})").alias("m"))
    return each.groupBy("win", "m", "h").agg(F.collect_set("item").alias("items"))


def _hits(windows: DataFrame) -> str:
    """SQL for the places in the words `w` where a window starts: an array of (pos, m, win).

    The set holds the windows' hashes; words are compared only where the hash is in the set.
    """
    known = windows.select("win", "m", "h").collect()  # at most SET_WINDOWS rows of SET_BYTES together
    found = []
    for m in sorted({r["m"] for r in known}):
        hashes = ", ".join(sorted({f"{r['h']}L" if r["h"] > -(2**63) else "long('-9223372036854775808')" for r in known if r["m"] == m}))
        listed = ", ".join(f"'{r['win']}'" for r in known if r["m"] == m)  # words hold no quote and no backslash
        near = f"filter(sequence(0, size(w) - {m}), i -> xxhash64(slice(w, i + 1, {m})) in ({hashes}))"
        found.append(f"if(size(w) < {m}, array(), filter(transform({near}, i -> named_struct('pos', i, 'm', {m}, 'win', array_join(slice(w, i + 1, {m}), ' '))), x -> x.win in ({listed})))")
    return f"concat({', '.join(found)})" if found else "cast(array() as array<struct<pos:int,m:int,win:string>>)"


def _once(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and body with it: the optimizer may copy a column into every use, even into
    a lambda that runs once a word, but not a lambda's own variable."""
    return f"transform(array({value}), {name} -> {body})[0]"


def fits_in_tasks(windows: DataFrame) -> bool:
    size = windows.agg(F.count("*").alias("n"), F.sum(F.octet_length("win")).alias("b")).first()
    return size["n"] <= SET_WINDOWS and (size["b"] or 0) <= SET_BYTES


_COVERED = "array_sort(array_distinct(flatten(transform({hits}, h -> sequence(h.pos, h.pos + h.m - 1)))))"
RESULTS = ("n_words", "covered", "items")


def _row(docs: DataFrame, names: list[str]) -> Column:
    """The columns of a row as one, so that no name of theirs meets a helper's."""
    return F.struct(*[F.col(f"`{n}`") for n in names]) if names else F.struct(F.lit(1).alias("none"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """docs' columns (those of carry, if given) with n_words, covered (positions of hit words) and items (ids of the items found, sorted).

    A word is hit if a window of some item's words, in the same order, lies over it. Null texts have no words.
    Windows of items without an id hit words as well, and name no item. Repeated rows are judged each; empty tables
    give no hits or no rows; columns that have the names of results are replaced, any other name may stand.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    windows = benchmark_windows(benchmark, window)
    # rows that repeat all columns are told apart by a number; it does not outlive the grouping below
    rows = docs.select(_row(docs, names).alias("doc"), F.col("text").cast("string").alias("given"), F.monotonically_increasing_id().alias("row"))
    if fits_in_tasks(windows):
        body = _once(_hits(windows), "h", f"named_struct('n', size(w), 'covered', {_COVERED.format(hits='h')}, 'wins', array_distinct(h.win))")
        marked = rows.select("doc", "row", words_of(F.col("given")).alias("words")).select("doc", "row", F.expr(_once("words", "w", body)).alias("m"))
        each = marked.select(F.struct("row", F.col("m.n").alias("n_words"), "doc").alias("d"), F.col("m.covered").alias("covered"), F.explode_outer("m.wins").alias("win"))
        joined = each.join(F.broadcast(windows.select("win", "items")), "win", "left")
        grouped = joined.groupBy("d.row").agg(F.first("d").alias("d"), F.first("covered").alias("covered"), F.flatten(F.collect_list("items")).alias("items"))
    else:
        # two branches follow, so the numbers are written: a second evaluation might deal them anew
        rows = written(rows, "decontamination-rows").select("doc", "row", words_of(F.col("given")).alias("w"))
        lengths = [r["m"] for r in windows.select("m").distinct().collect()]  # at most `window` numbers
        every = F.concat(*[F.expr(f"if(size(w) < {m}, array(), transform(sequence(0, size(w) - {m}), i -> named_struct('pos', i, 'm', {m}, 'win', array_join(slice(w, i + 1, {m}), ' '))))") for m in sorted(lengths)])
        each = rows.select("row", F.explode(every).alias("p")).select("row", "p.*")
        joined = each.join(windows, ["win", "m"])
        hit = joined.groupBy("row").agg(F.collect_set(F.struct("pos", "m")).alias("h"), F.flatten(F.collect_set("items")).alias("items"))
        whole = rows.select("row", F.struct("row", F.size("w").alias("n_words"), "doc").alias("d"))
        grouped = whole.join(hit, "row", "left").withColumn("covered", F.expr(_COVERED.format(hits="coalesce(h, array())")))
    return grouped.select(
        *[F.col(f"d.doc.`{n}`") for n in names],
        F.col("d.n_words").cast("long").alias("n_words"),
        "covered",
        F.array_sort(F.array_distinct(F.coalesce(F.col("items"), F.array().cast("array<string>")))).alias("items"),
    )


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the hit words, and what separates each from the next word, cut out of the text.

    Texts without a hit stay as they are, byte for byte, null and empty ones too; a document whose words were all hit
    goes. Repeated rows are judged each; an empty table gives an empty result; any other column may stand beside.
    """
    names = docs.columns
    windows = benchmark_windows(benchmark, window)
    keep = "size(x.c) = 0 or size(x.c) < x.n"
    if fits_in_tasks(windows):
        found = _once("words", "w", f"named_struct('n', size(w), 'c', {_once(_hits(windows), 'h', _COVERED.format(hits='h'))})")
        judged = docs.select(_row(docs, names).alias("doc"), words_of(F.col("text").cast("string")).alias("words")).select("doc", F.expr(found).alias("s"))
    else:
        whole = docs.select(_row(docs, names).alias("doc"), F.col("text").cast("string").alias("text"))
        judged = contamination(whole, benchmark, window, carry=["doc"]).select("doc", F.struct(F.col("n_words").alias("n"), F.col("covered").alias("c")).alias("s"))
    # a generator keeps the optimizer from evaluating the words once for the filter and once for the text
    kept = judged.select("doc", F.explode(F.expr(f"filter(array(s), x -> {keep})")).alias("s"))
    # 'a, b. c' is '' + (a ', ') (b '. ') (c ''): separator i stands before word i
    parts = kept.select("doc", "s", F.array_remove(F.split(F.col("doc.text"), _RAW_SEPARATORS), "").alias("raw"), F.split(F.col("doc.text"), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").alias("between"))
    rest = "array_join(transform(raw, (x, i) -> if(array_contains(c, i), '', concat(x, coalesce(get(sep, i + 1), '')))), '')"
    rest = _once("between", "sep", _once("s.c", "c", f"concat(sep[0], {rest})"))
    text = F.when(F.size("s.c") > 0, F.expr(rest)).otherwise(F.col("doc.text"))
    return parts.select(*[text.alias("text") if n == "text" else F.col(f"doc.`{n}`") for n in names])
