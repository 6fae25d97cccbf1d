"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

*Template.*  Numbers, units after a number and names (capitalised words inside a sentence) become typed
placeholders; other words are lower-cased, punctuation goes.  A question that was asked anew with other
numbers or names has the template it had.

*Windows.*  Both sides have every window of ``WINDOW`` template words, so any common stretch of that
many words proposes its place, wherever it starts.  Whether an item's first word counts as a name depends on
what stands before it, so the item's first window is there in both forms.  A window without a literal word
fits any table of numbers and is left out.  An item of fewer words, or of slots only, is known by its first
``WINDOW`` words, values included, and must stand in the document word by word.

*Stretches.*  Each offset that windows propose lays the item on the document's words.  Inserted or deleted
words shift the rest, so the stretches (``RUN`` agreeing words or more) of offsets that lie no further apart
than half the item are also tried together; no word of either side counts twice.  Such sets begin at every
offset; where ``DENSE`` others precede one within that distance (a text that repeats one template), at one in
each eighth of the item, so that the work grows with the text and not with its square.  Enough of the item must
agree, in a short one more and a least number of literal words, and enough of what agrees must be literal.

*Slots.*  Inside stretches of ``WINDOW`` words or more a value of the item must be the same one everywhere, and two names must not
become one (two numbers or units may): at most ``MAX_MIXED`` of the slots may break this.  Outside, where the
document may have gone on with its own words, a slot that breaks it just does not agree.

Arrays that are costly to make are unfolded by ``explode_outer`` (none is empty, or the next join drops the null):
``explode`` would add a test of their size, which the optimizer makes below, from the whole text, once an entry.
Windows meet in a hash join.  The benchmark's windows and the proposed documents are broadcast only
where a count shows at most ``BROADCAST_ROWS`` rows and words; beyond that the same join shuffles.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.llm.common import kept, table

WINDOW = 6
RUN = 3
LEAST_COVER = 0.5
LEAST_LITERAL = 0.5
MAX_MIXED = 0.25
DENSE = 8
SHORT, SHORT_COVER, SHORT_LITERALS = 16, 0.75, 5  # items of fewer words; a verbatim copy always counts
BROADCAST_ROWS = 1_000_000

# fixed values: units that may follow a number
UNITS = ("mm cm m km in inch inches ft foot feet yard yards yd mile miles mg g kg lb lbs oz ounce ounces pound pounds ton tons "
         "tonne tonnes ml cl l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day "
         "days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees mph kph "
         "kb mb gb tb w kw kwh v a hz khz mhz ghz j kj cal kcal").split()
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"  # private-use characters
_MARKS = f"{NUMBER}-{NAME}"
_CUT = rf"(?:[^\p{{L}}\p{{N}}{_MARKS}.,]|[.,](?!\d))+"


def _marked(text: Column) -> Column:
    """The text with a mark before the value of each slot."""
    names = F.regexp_replace(text, r" (?<=[\p{L}\p{N},;] )(?=\p{Lu}\p{Ll})", f" {NAME}")
    # a number or a unit was not marked as a name: digits are no letters, units stand after digits
    numbers = F.regexp_replace(names, r"\d+(?:[.,]\d+)*", f" {NUMBER}$0 ")
    units = F.regexp_replace(numbers, rf"({NUMBER}\S+) +{NAME}?(?i)({'|'.join(UNITS)}|%)(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2 ")
    units = F.regexp_replace(units, f"{UNIT}%", f"{UNIT}percent")
    return F.lower(F.when(text.rlike(r"\d"), units).otherwise(names))


def _words(marked: Column) -> Column:
    return F.filter(F.split(marked, _CUT), lambda w: w != "")


def _template(marked: Column) -> Column:
    """The marked text with slots emptied: the same number of words."""
    has = F.regexp_like(marked, F.lit(f"[{_MARKS}]"))
    return F.when(has, F.regexp_replace(marked, rf"([{_MARKS}])(?:[\p{{L}}\p{{N}}]|[.,](?=\d))+", "$1")).otherwise(marked)


def _bare(text: Column) -> Column:
    """The marked text or word without marks: the same number of words."""
    return F.regexp_replace(text, f"[{_MARKS}]", "")


def _is_slot(word: Column) -> Column:
    return word.isin(NUMBER, UNIT, NAME)


def _window_hashes(words: Column, width: int = WINDOW) -> Column:
    """[{at, window}] of all windows; each is a 64-bit hash, checked word by word later."""
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(words, i + 1, F.lit(width))).alias("window")))).otherwise(F.array())


def _verbatim_only(template: Column) -> Column:
    """Items of few words or of slots only."""
    return (F.size(template) < WINDOW) | ~F.exists(template, lambda w: ~_is_slot(w))


def _item_windows(bare: Column, template: Column) -> Column:
    """[{at, window}] of an item's windows with a literal word; the first also with a name for its first word."""
    literal = lambda words: F.exists(words, lambda w: ~_is_slot(w))
    rest = F.slice(template, 2, WINDOW - 1)
    named = F.struct(F.lit(0).alias("at"), F.xxhash64(F.concat(F.array(F.lit(NAME)), rest)).alias("window"))
    first = F.when(~_is_slot(template[0]) & literal(rest), F.array(named)).otherwise(F.array())
    windows = F.filter(_window_hashes(template), lambda w: literal(F.slice(template, w["at"] + 1, F.lit(WINDOW))))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.slice(bare, 1, WINDOW)).alias("window")))
    return F.when(_verbatim_only(template), whole).otherwise(F.concat(windows, first))


def _near(starts: Column, n: Column, verbatim_only: Column) -> Column:
    """Sorted offsets to lay an item at: each alone, and sets of those that follow one within half the item."""
    reach = F.greatest(F.lit(WINDOW), F.floor(n / 2).cast("int"))
    band = lambda s: F.floor(s / F.floor(reach / 4))
    alone = F.transform(starts, lambda s: F.array(s))

    def joined(s, k):
        dense = F.coalesce(F.get(starts, k - DENSE) >= s - reach, F.lit(False))
        # offsets are distinct and sorted: all within reach are among the next reach + 1
        near = F.filter(F.slice(starts, k + 1, reach + 1), lambda x: x <= s + reach)
        return F.when(~dense | (band(s) != band(F.get(starts, k - 1))), near).otherwise(F.array())

    return F.when((F.size(starts) == 1) | verbatim_only, alone).otherwise(
        F.concat(alone, F.filter(F.transform(starts, joined), lambda near: F.size(near) > 1)))


def _agreeing(n: Column) -> Column:
    """[{i, slot, item, at, doc, doc_slot, agrees, run, core}] of the item's words that agree with the document's, by
    ``starts``: of one offset all, of several the stretches, where no word of either side comes twice.  ``core``:
    in a stretch that could have proposed the offset."""
    def cell(s, i):
        k = s + i - F.col("first")  # positions outside the document are null and agree with nothing
        slot, item, doc, doc_slot = F.col("item_template")[i], F.col("item_bare")[i], F.get("bare", k), F.get("template", k)
        agrees = F.coalesce((slot == doc_slot) | (item == doc), F.lit(False))
        return F.struct(i.alias("i"), slot.alias("slot"), item.alias("item"), (s + i).alias("at"), doc.alias("doc"),
                        doc_slot.alias("doc_slot"), agrees.alias("agrees"))

    def in_run(row, i, least):
        on = lambda k: F.coalesce(F.get(row, i + k)["agrees"], F.lit(False))
        spans = [[on(k) for k in range(-back, least - back)] for back in range(least)]
        return reduce(or_, [reduce(and_, span) for span in spans])

    cells = F.transform("starts", lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: cell(s, i)))
    rows = F.transform(cells, lambda row: F.transform(row, lambda p, i: p.withField("run", in_run(row, i, RUN)).withField("core", in_run(row, i, WINDOW))))
    several = F.size("starts") > 1
    agreeing = F.filter(F.flatten(rows), lambda p: p["run"] | (p["agrees"] & ~several))
    # the first of each word of the item, if it is also the first of its word of the document
    once = lambda x: F.filter(x["cells"], lambda p, k: (F.array_position(x["i"], p["i"]) == k + 1)
                              & (F.array_position(x["at"], p["at"]) == k + 1))
    split = lambda x: F.struct(x.alias("cells"), x["i"].alias("i"), x["at"].alias("at"))
    parts = F.transform(F.array(agreeing), split)
    return F.transform(parts, lambda x: F.when(several, once(x)).otherwise(x["cells"]))[0]


def _small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """Broadcast if the rows, and the entries ``size`` of their arrays, are few."""
    total = df.agg(F.sum(F.lit(1) + (F.lit(0) if size is None else size))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_ROWS else df


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document text and benchmark text of which it holds enough: doc_id, text_hash,
    item_id (the smallest with that text), item_ids, n_words of the item, matched, literal, slots,
    changed (slots with another value), starts_at (word of the document, by the first offset; may be negative
    where the item's beginning is missing).

    Null texts, and items without a word, match nothing.  Repeated rows of a document give one result; a null doc_id is reported as null.  Of several places the one with most
    agreement counts.  Other columns are ignored.
    """
    docs = documents.filter("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    items = benchmark.filter("text is not null").groupBy(_marked(F.col("text")).alias("marked")).agg(
        F.min("item_id").alias("item_id"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    items = items.select("item_id", "item_ids", _words(F.col("marked")).alias("item_words"), _words(_bare(F.col("marked"))).alias("item_bare"),
                         _words(_template(F.col("marked"))).alias("item_template"))
    items = kept(items.filter(F.size("item_words") > 0).withColumn("item", F.xxhash64("item_words")), "items")

    asked = items.select("item", F.size("item_words").alias("n"), _verbatim_only(F.col("item_template")).alias("verbatim_only"),
                         F.explode(_item_windows(F.col("item_bare"), F.col("item_template"))).alias("w"))
    asked = kept(asked.select("item", "n", "verbatim_only", F.col("w.at").alias("item_at"), F.col("w.window").alias("window")), "item-windows")
    # at most WINDOW lengths of items that are known by their words, mostly none
    shorter = sorted(r.n for r in items.filter(_verbatim_only(F.col("item_template"))).select(
        F.least(F.size("item_words"), F.lit(WINDOW)).alias("n")).distinct().collect())
    marked = docs.select("doc_id", "text_hash", _marked(F.col("text")).alias("marked"))
    worded = marked.select("doc_id", "text_hash", _words(_template(F.col("marked"))).alias("template"),
                           *([_words(_bare(F.col("marked"))).alias("bare")] if shorter else []))
    windows = F.concat(_window_hashes(F.col("template")), *[_window_hashes(F.col("bare"), n) for n in shorter])
    found = worded.select("doc_id", "text_hash", F.explode_outer(windows).alias("w")).select(
        "doc_id", "text_hash", F.col("w.at").alias("at"), F.col("w.window").alias("window"))
    offsets = found.join(_small(asked), "window").select(
        "doc_id", "text_hash", "item", "n", "verbatim_only", (F.col("at") - F.col("item_at")).alias("starts_at")).distinct()
    places = offsets.groupBy("doc_id", "text_hash", "item", "n", "verbatim_only").agg(F.array_sort(F.collect_set("starts_at")).alias("starts"))
    places = places.select("doc_id", "text_hash", "item", "n", F.explode_outer(_near(F.col("starts"), F.col("n"), F.col("verbatim_only"))).alias("starts"))
    offsets = kept(places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item", "starts", "n")).alias("tries")), "offsets")

    tries = offsets.withColumnsRenamed({"doc_id": "t_id", "text_hash": "t_hash"})
    entries = F.aggregate("tries", F.lit(0).cast("long"), lambda n, t: n + F.size(t["starts"]))
    texts = docs.join(_small(tries, entries), docs["doc_id"].eqNullSafe(tries["t_id"]) & (docs["text_hash"] == tries["t_hash"]))
    marked = texts.select("doc_id", "text_hash", "tries", _marked(F.col("text")).alias("marked"))
    words = marked.select("doc_id", "text_hash", "tries", _words(_bare(F.col("marked"))).alias("bare"),
                          _words(_template(F.col("marked"))).alias("template"))
    # only the words below the item go on, however many items a long document holds
    first = lambda t: F.greatest(t["starts"][0], F.lit(0))
    below = lambda words, t: F.slice(words, first(t) + 1, F.greatest(F.element_at(t["starts"], -1) + t["n"] - first(t), F.lit(0)))
    laid = words.select("doc_id", "text_hash", F.explode_outer(F.transform("tries", lambda t: F.struct(
        t["item"].alias("item"), t["starts"].alias("starts"), first(t).alias("first"),
        below("bare", t).alias("bare"), below("template", t).alias("template")))).alias("try"))
    laid = laid.select("doc_id", "text_hash", "try.*")
    laid = laid.join(_small(items, 3 * F.size("item_words")), "item")
    laid = laid.select("doc_id", "text_hash", "item_id", "item_ids", "starts", F.size("item_words").alias("n_words"),
                       _agreeing(F.size("item_words")).alias("same"))
    # a word that is a slot on one side only is a literal one: it agrees as it stands
    value = lambda p: _is_slot(p["slot"]) & (p["slot"] == p["doc_slot"])
    laid = laid.withColumn("known", F.array_distinct(F.transform(
        F.filter("same", lambda p: p["core"] & value(p)),
        lambda p: F.struct(p["slot"].alias("slot"), p["item"].alias("item"), p["doc"].alias("doc")))))
    parted = lambda p: F.exists("known", lambda k: (k["slot"] == p["slot"]) & (k["item"] == p["item"]) & (k["doc"] != p["doc"]))
    merged = lambda p: (p["slot"] == NAME) & F.exists(
        "known", lambda k: (k["slot"] == NAME) & (k["doc"] == p["doc"]) & (k["item"] != p["item"]))
    laid = laid.withColumn("same", F.filter("same", lambda p: p["core"] | ~value(p) | ~parted(p)))
    laid = laid.withColumn("values", F.filter("same", value))
    laid = laid.select(
        "doc_id", "text_hash", "item_id", "item_ids", F.col("starts")[0].alias("starts_at"), "n_words", F.size("same").alias("matched"),
        (F.size("same") - F.size("values")).alias("literal"), F.size("values").alias("slots"),
        F.size(F.filter("values", lambda p: p["item"] != p["doc"])).alias("changed"),
        ((F.size("starts") == 1) & (F.size(F.filter("same", lambda p: p["item"] == p["doc"])) == F.col("n_words"))).alias("verbatim"),
        F.size(F.filter("values", lambda p: p["core"])).alias("held"),
        F.size(F.filter("values", lambda p: p["core"] & (parted(p) | merged(p)))).alias("mixed"))
    # written before the rows are judged: the optimizer would move the test into the join above, where each
    # array is made anew for every entry of those that use it
    laid = kept(laid, "laid")
    enough = F.when(F.col("n_words") < SHORT, (F.col("matched") >= SHORT_COVER * F.col("n_words")) & (F.col("literal") >= SHORT_LITERALS)) \
        .otherwise(F.col("matched") >= LEAST_COVER * F.col("n_words"))
    laid = laid.filter(F.col("verbatim") | (
        (F.col("n_words") >= WINDOW) & enough & (F.col("mixed") <= MAX_MIXED * F.col("held"))
        & (F.col("literal") >= LEAST_LITERAL * F.col("matched"))))
    best = F.struct("matched", "literal", (-F.col("starts_at")).alias("earlier"), "slots", "changed")
    return laid.groupBy("doc_id", "text_hash", "item_id").agg(*[
        F.max_by(c, best).alias(c) for c in ("item_ids", "n_words", "matched", "literal", "slots", "changed", "starts_at")])


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark text, rows and columns as they are."""
    found = contaminated(documents, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    found = kept(found, "contaminated")
    return documents.join(
        _small(found), documents["doc_id"].cast("long").eqNullSafe(found["_id"])
        & (F.xxhash64(documents["text"]) == found["_hash"]), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, one row for each benchmark text they hold."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "matched", "literal", "slots", "changed", "starts_at")]
    return found.select("doc_id", F.col("item_id").cast("long").alias("item_id"), *longs)
