"""Line dedup by winnowing over hashes of line pieces (DataFrame functions only).

*Pieces.*  A text is its words; lines are read on into each other, so that a passage is known however
its lines are wrapped and wherever in a line it begins or ends.  A piece is ``PIECE`` words in a row.

*Fingerprints.*  Each window of ``MIN_WORDS`` words selects the smallest hash of its pieces.  The choice
depends on the window's words alone, so equal runs of ``MIN_WORDS`` words select equal fingerprints wherever
they stand: none can be missed.  Windows in a row with one fingerprint are one *reach*, about one for each
22 words of prose.

*Positions.*  A fingerprint found once proves all windows of its reach unique, and they go no further.  Reaches
with one fingerprint and the same words are joined to the first of them.

*Extension.*  Where reaches of one fingerprint differ, the first of each kind goes back to its text: from the
fingerprint the match is extended both ways, window by window, and each is joined to its first place.
Windows that overlap or touch make one longer run, so a run ends at the word where two places differ.

*Deletion.*  Of each repeated run the first place (smallest doc_id, then word) keeps its words, every later one
loses them, in the edge lines, too.  A place that overlaps the first one in its own document is not a later one.

A place is compared with first places only: work is linear in the words, also for a passage that a third of
all documents hold.  Keys with more than one row in ``HOT_SHARE`` are fewer than ``HOT_SHARE``, so they are
joined by broadcast and their rows stay where they are; other keys are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fablake.llm.common import kept, table

MIN_WORDS = 50
PIECE = 8
HOT_SHARE = 1000
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"
_PLACE = ("doc_id", "text_hash", "s")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _chained(df: DataFrame, name: str, start: str, steps: list[int], how) -> DataFrame:
    """``df`` with array ``start`` replaced by ``name``: element i is combined with the one ``step`` further on,
    step by step.  Elements too near to the end hold less than the full span and are left to the caller."""
    others = [c for c in df.columns if c != start]
    for step in steps:  # a select for each step: an array is made once, not once an element
        df = df.select(*others, F.zip_with(start, F.slice(start, step + 1, F.greatest(F.size(start) - step, F.lit(0))), how).alias(name))
        start = name
    return df


def _steps(span: int) -> list[int]:
    """Distances that combine 1 element to ``span`` elements."""
    steps, have = [], 1
    while have < span:
        steps.append(min(have, span - have))
        have += steps[-1]
    return steps


def _hashed(df: DataFrame, name: str, start: str, span: int) -> DataFrame:
    return _chained(df, name, start, _steps(span), lambda x, y: F.xxhash64(x, y))


def _place(prefix: str = "") -> Column:
    """Order of places; a null doc_id comes last."""
    at = [F.col(prefix + c) for c in _PLACE]
    return F.struct(at[0].isNull().alias("unnamed"), *[c.alias(n) for c, n in zip(at, _PLACE)])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.filter("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("words"))


def _reaches(documents: DataFrame, min_words: int, piece: int) -> DataFrame:
    """(doc_id, text_hash, mark, kind, s, e): windows from word s to word e share the fingerprint ``mark``;
    ``kind`` is a hash of all their words."""
    texts = _texts(documents).filter(F.size("words") >= min_words)
    texts = texts.select("doc_id", "text_hash", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    texts = _hashed(texts.withColumn("pieces", F.col("hashes")), "pieces", "pieces", piece)
    texts = texts.withColumn("pieces", F.slice("pieces", 1, F.size("pieces") - piece + 1))
    texts = _chained(texts, "marks", "pieces", _steps(min_words - piece + 1), lambda x, y: F.least(x, y))
    texts = texts.withColumn("marks", F.slice("marks", 1, F.size("hashes") - min_words + 1))
    # the windows whose fingerprint is not that of the window before
    begins = F.filter(F.sequence(F.lit(0), F.size("marks") - 1), lambda i: ~F.get("marks", i).eqNullSafe(F.get("marks", i - 1)))
    texts = texts.select("doc_id", "text_hash", "hashes", "marks", begins.alias("begins"))
    reach = F.transform("begins", lambda s, k: F.struct(
        s.alias("s"), (F.coalesce(F.get("begins", k + 1), F.size("marks")) - 1).alias("e")))
    # explode_outer: explode would infer a filter on the array's size, pushed below the selects that make it
    each = texts.select("doc_id", "text_hash", F.explode_outer(F.transform(reach, lambda r: F.struct(
        F.get("marks", r["s"]).alias("mark"), r["s"].alias("s"), r["e"].alias("e"),
        F.xxhash64(F.slice("hashes", r["s"] + 1, r["e"] - r["s"] + min_words)).alias("kind")))).alias("r"))
    return each.select("doc_id", "text_hash", "r.mark", "r.kind", "r.s", "r.e")


def _met(rows: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join with ``found``, one row a key with its number of rows ``n``, which add up to ``total`` at most."""
    hot = F.broadcast(found.filter(F.col("n") > total // HOT_SHARE))  # fewer than HOT_SHARE + 1 rows
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(found.filter(F.col("n") <= total // HOT_SHARE), keys)
    return rows.join(hot, keys).unionByName(cold)


def _later(min_words: int) -> Column:
    """The place comes after the first one and does not overlap it."""
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return F.when(same, F.col("s") >= F.col("first.s") + min_words).otherwise(_place() > F.col("first"))


def _islands(spans: DataFrame) -> DataFrame:
    """(doc_id, text_hash, s, e) to (doc_id, text_hash, deleted): spans that overlap or touch are one."""
    document = Window.partitionBy("doc_id", "text_hash").orderBy("s", "e")
    spans = spans.withColumn("upto", F.max("e").over(document.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("s") <= F.col("upto"), 0).otherwise(1)).over(document))
    runs = spans.groupBy("doc_id", "text_hash", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("deleted"))


def repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS, piece: int = PIECE) -> DataFrame:
    """(doc_id, text_hash, deleted): [{s, e}], in order, of the words from s to e - 1 that lie in a run of at least
    ``min_words`` words which also stands at an earlier place; documents without one are left out."""
    reaches = kept(_reaches(documents, min_words, piece), "reaches")
    total = reaches.count()
    kinds = kept(reaches.groupBy("mark", "kind").agg(
        F.min(_place()).alias("first"), F.count("*").alias("n"), F.max(F.col("e") - F.col("s")).alias("more")), "kinds")
    members = _met(reaches, kinds.filter("n > 1").drop("more"), ["mark", "kind"], total)
    members = kept(members.filter(_place() != F.col("first")).withColumn("later", _later(min_words)).drop("first", "n"), "members")
    whole = members.filter("later").select("doc_id", "text_hash", "s", (F.col("e") + min_words).alias("e"))

    # the first of each kind goes back to its text where its fingerprint has other kinds, or its windows may repeat each other
    marks = kinds.groupBy("mark").agg(F.count("*").alias("n"), F.max("more").alias("most")).filter((F.col("n") > 1) | (F.col("most") >= min_words))
    firsts = _met(kinds.select("mark", "first", "more"), marks, ["mark"], total)
    firsts = firsts.select("mark", "more", F.col("first.doc_id"), F.col("first.text_hash"), F.col("first.s"))
    overlapping = members.filter("not later").select("mark", (F.col("e") - F.col("s")).alias("more"), "doc_id", "text_hash", "s")
    asked = firsts.unionByName(overlapping).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("mark", "s", "more")).alias("asked"))
    asked = asked.withColumnsRenamed({"doc_id": "a_id", "text_hash": "a_hash"})
    texts = documents.filter("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.join(asked, texts["doc_id"].eqNullSafe(asked["a_id"]) & (texts["text_hash"] == asked["a_hash"]))
    texts = texts.select("doc_id", "text_hash", "asked", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    parts = texts.select("doc_id", "text_hash", F.explode_outer(F.transform("asked", lambda a: F.struct(
        a["mark"].alias("mark"), a["s"].alias("s"), F.slice("hashes", a["s"] + 1, a["more"] + min_words).alias("part")))).alias("p"))
    parts = parts.select("doc_id", "text_hash", "p.mark", F.col("p.s").alias("from"), F.col("p.part").alias("part"))
    parts = _hashed(parts, "part", "part", min_words)
    parts = parts.withColumn("part", F.slice("part", 1, F.size("part") - min_words + 1))
    windows = kept(parts.select("doc_id", "text_hash", "mark", "from", F.posexplode_outer("part").alias("at", "content")).filter("content is not null").select(
        "doc_id", "text_hash", "mark", "content", (F.col("from") + F.col("at")).alias("s")), "windows")
    found = windows.groupBy("mark", "content").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).filter("n > 1")
    matched = _met(windows, kept(found, "found"), ["mark", "content"], windows.count())
    extended = matched.filter(_later(min_words)).select("doc_id", "text_hash", "s", (F.col("s") + min_words).alias("e"))
    return _islands(whole.unionByName(extended))


def _cut(text: Column, runs: Column) -> Column:
    """The text without the words of ``runs``.  What stood before the first word stays; a run takes the space after
    its words along.  Where it ends a line that it did not begin, the line break stays."""
    lead = F.regexp_extract(text, rf"^{_SPACE}", 0)
    words = F.regexp_extract_all(text, F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))

    def piece(words, a, b):
        return F.array_join(F.slice(words, a + 1, F.greatest(b - a, F.lit(0))), "")

    def gap(words, r, k):
        """What is kept before run k, and the line break that is left of the run."""
        start = F.when(k == 0, 0).otherwise(F.get(runs, k - 1)["e"])
        kept_ = piece(words, start, r["s"])
        broken = (r["s"] > 0) & ~F.get(words, r["s"] - 1).contains("\n") & piece(words, r["s"], r["e"]).contains("\n")
        return F.concat(kept_, F.when(broken, "\n").otherwise(""))

    def whole(words):
        return F.concat(F.array_join(F.transform(runs, lambda r, k: gap(words, r, k)), ""),
                        piece(words, F.element_at(runs, -1)["e"], F.size(words)))

    return F.concat(lead, F.transform(F.array(words), whole)[0])


def drop_repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` (doc_id, text and any other columns) with the text cut, and two columns more:
    ``n_words`` (of the whole text) and ``deleted`` (array of {s, e}: words s to e - 1 went; empty if none).

    A null text stays null (no words); a text of fewer than ``min_words`` words stays as it is.  Rows with the same
    doc_id and text are one document and all keep or lose the same words; equal doc_ids with
    different texts are different documents, in the order of their texts' hashes; a null doc_id comes last.
    Input columns named n_words or deleted are replaced.
    """
    documents = documents.drop("n_words", "deleted")
    runs = repeated_runs(documents.select("doc_id", "text"), min_words).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "deleted")
    joined = documents.join(
        runs, documents["doc_id"].cast("long").eqNullSafe(runs["_id"]) & (F.xxhash64(documents["text"]) == runs["_hash"]), "left")
    return joined.select(
        *[c for c in documents.columns if c != "text"],
        F.when(F.col("deleted").isNull(), F.col("text")).otherwise(_cut(F.col("text"), F.col("deleted"))).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long").alias("n_words"),
        F.coalesce("deleted", F.array().cast("array<struct<s:int,e:int>>")).alias("deleted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_deleted (words) and the text that is left, for every document."""
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.aggregate("deleted", F.lit(0), lambda n, r: n + r["e"] - r["s"])
    return out.select("doc_id", "n_words", n.cast("long").alias("n_deleted"), "text")


#: The definition itself: every window of the least number of words, compared word by word.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, text, regexp_extract(text, '^[\x20\x09-\x0D]+') AS lead,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS t
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(0, len(w) - {MIN_WORDS - 1})) AS s, unnest(list_transform(
    range(1, len(w) - {MIN_WORDS - 2}), lambda i: array_to_string(list_slice(w, i, i + {MIN_WORDS - 1}), ' '))) AS content
  FROM d WHERE len(w) >= {MIN_WORDS}),
k AS (SELECT content, min({{'a': doc_id, 'b': s}}) AS f FROM g GROUP BY content HAVING count(*) > 1),
p AS (SELECT content, f.a AS first_doc, f.b AS first_s FROM k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + {MIN_WORDS})) AS i FROM g JOIN p USING (content)
  WHERE CASE WHEN doc_id = first_doc THEN s >= first_s + {MIN_WORDS} ELSE doc_id > first_doc END),
t AS (SELECT doc_id, unnest(t) AS word, unnest(range(0, len(t))) AS i FROM d),
m AS (SELECT t.doc_id, t.i, word, gone.i IS NOT NULL AS cut FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.i = t.i),
r AS (
  SELECT *, lag(cut) OVER o AS was, lag(contains(word, chr(10))) OVER o AS ended, lead(cut) OVER o AS goes_on,
         sum(CASE WHEN cut THEN 0 ELSE 1 END) OVER o AS run FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, run, bool_or(contains(word, chr(10))) FILTER (cut) AS has, bool_or(ended IS NOT NULL AND NOT ended) FILTER (cut AND was IS DISTINCT FROM true) AS inside
      FROM r GROUP BY doc_id, run),
x AS (
  SELECT doc_id, count(*) AS n, sum(cut::INT) AS n_deleted, string_agg(
    CASE WHEN NOT cut THEN word WHEN goes_on IS DISTINCT FROM true AND has AND inside THEN chr(10) ELSE '' END, '' ORDER BY i) AS text
  FROM r JOIN b USING (doc_id, run) GROUP BY doc_id)
SELECT d.doc_id, coalesce(x.n, 0) AS n_words, coalesce(x.n_deleted, 0)::BIGINT AS n_deleted,
       CASE WHEN coalesce(x.n_deleted, 0) = 0 THEN d.text ELSE lead || x.text END AS text
FROM d LEFT JOIN x USING (doc_id)
"""
