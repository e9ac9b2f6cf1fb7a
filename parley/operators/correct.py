"""Correction of transcripts: segments, which of them need it, gating of proposed changes, glossaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.folds import fold_rows, numbered
from parley.functions.automaton import contains_any
from parley.functions.diffs import opcodes_within
from parley.functions.text import CJK, in_order
from parley.operators.clean import stripped
from parley.sources.store import materialised

SENTENCE_END = r"(?<=[。！？!?\n])"
MAX_ALTERNATIVES = 2000


def _pieces(text: Column, max_chars: int) -> Column:
    """A text's sentences; long ones by white space; pieces still long in equal cuts."""
    # Words with the white space before them, as a long sentence is filled word by word.
    words = lambda s: F.when(F.length(s) > max_chars, F.regexp_extract_all(s, F.lit(r"(?U)\s*\S+|\s+$"), 0)).otherwise(F.array(s))
    cuts = lambda w: F.when(F.length(w) > max_chars, F.regexp_extract_all(w, F.lit(f"(?s).{{1,{max_chars}}}"), 0)).otherwise(F.array(w))
    sentences = F.filter(F.split(text, SENTENCE_END), lambda s: s != "")
    return F.flatten(F.transform(F.flatten(F.transform(sentences, words)), cuts))


def pack(rows: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Greedy packing: rows of a key, in order, go to groups whose sizes sum to ``budget`` at most; adds ``pack_no``.

    Only the sizes reach Python, as one stream of sorted rows. A row beyond the budget is a group.
    """

    def start():
        no, held = -1, 0

        def step(values: tuple) -> tuple:
            nonlocal no, held
            if no < 0 or held + values[0] > budget:
                no, held = no + 1, 0
            held += values[0]
            return (no,)

        return step

    return fold_rows(rows, key, order, [size], start, "pack_no int")


def segment_for_correction(docs: DataFrame, max_chars: int = 400) -> DataFrame:
    """K1: (doc_id, seg_no, text), each of ``max_chars`` at most; joined they are the document.

    Documents are dealt out once and cut where they are; Python sees the pieces' sizes, not their texts."""

    @F.pandas_udf("array<int>")
    def firsts(sizes: pd.Series) -> pd.Series:
        """Which pieces begin a segment, from 1; behind them, the number of pieces and one."""

        def one(of: list[int]) -> list[int]:
            found, held = [], max_chars
            for i, n in enumerate(of, 1):
                held += n
                if held > max_chars:
                    found.append(i)
                    held = n
            return [*found, len(of) + 1]

        return sizes.map(lambda x: None if x is None else one(x.tolist()))

    cut = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", _pieces(F.col("text"), max_chars).alias("pieces"))
    cut = cut.withColumn("firsts", firsts(F.transform("pieces", lambda x: F.length(x))))
    segment = lambda at, i: F.array_join(F.slice("pieces", at, F.get("firsts", i + 1) - at), "")
    return cut.select("doc_id", F.posexplode(F.transform(F.slice("firsts", 1, F.size("firsts") - 1), segment)).alias("seg_no", "text"))


def literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def any_of(forms: list[str]) -> str:
    """A pattern for the forms as a tree of their beginnings, so that few branches are tried at each position."""
    if "" in forms:
        return ""
    heads: dict[str, list[str]] = {}
    for f in forms:
        heads.setdefault(f[0], []).append(f[1:])
    branches = [literal(c + rest[0]) if len(rest) == 1 else literal(c) + any_of(rest) for c, rest in sorted(heads.items())]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


#: Forms of so many characters in all are sent to the workers as an automaton.
MAX_AUTOMATON = 2_000_000


def needs_correction(segments: DataFrame, pairs: DataFrame, max_alternatives: int = MAX_ALTERNATIVES, max_automaton: int = MAX_AUTOMATON) -> DataFrame:
    """K2: segments in which a known wrong form occurs. Few forms are one pattern in the scan; more are an automaton that each
    text is run through once; a table too large for that is joined with the substrings of its forms' lengths."""
    forms = pairs.where("wrong <> ''").select("wrong").distinct()
    few = forms.limit(max_alternatives + 1).collect()
    if len(few) <= max_alternatives:
        return segments.where(F.col("text").rlike(any_of([r["wrong"] for r in few]))) if few else segments.where(F.lit(False))
    if forms.agg(F.sum(F.length("wrong"))).first()[0] <= max_automaton:
        return segments.where(contains_any(segments.sparkSession, [r["wrong"] for r in forms.collect()])(F.col("text")))
    lengths = sorted(r["n"] for r in forms.select(F.length("wrong").alias("n")).distinct().collect())  # a few whole numbers
    grams = segments.select("doc_id", "seg_no", "text", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).where(F.length("text") >= F.col("n"))
    grams = grams.select("doc_id", "seg_no", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1), lambda i: F.substring(F.col("text"), i, F.col("n"))))).alias("wrong"))
    hit = grams.join(forms, "wrong", "left_semi").select("doc_id", "seg_no").distinct()
    return segments.join(hit, ["doc_id", "seg_no"], "left_semi")


# Initials and finals that are confused; neither relation is transitive.
NEAR_INITIALS = [("zh", "z"), ("ch", "c"), ("sh", "s"), ("l", "n"), ("f", "h"), ("r", "l")]
NEAR_FINALS = [("in", "ing"), ("en", "eng"), ("an", "ang"), ("uan", "uang"), ("ian", "iang"), ("o", "e"), ("uo", "o")]


def near_syllables(syllables: DataFrame, initials: list[tuple[str, str]] = NEAR_INITIALS, finals: list[tuple[str, str]] = NEAR_FINALS) -> DataFrame:
    """(a, b) of syllables (initial, final) that sound alike: each part is the same or a confused pair. Syllables are a
    bounded table (a language's inventory)."""
    spark = syllables.sparkSession
    inventory = syllables.select("initial", "final").distinct()

    def pairs(rows: list[tuple[str, str]], column: str) -> DataFrame:
        both = spark.createDataFrame([*rows, *((b, a) for a, b in rows)], f"{column} string, other_{column} string")
        return both.unionByName(inventory.select(column).distinct().withColumn(f"other_{column}", F.col(column))).distinct()

    near = inventory.join(pairs(initials, "initial"), "initial").join(pairs(finals, "final"), "final")
    known = inventory.select(F.col("initial").alias("other_initial"), F.col("final").alias("other_final"))
    found = near.join(known, ["other_initial", "other_final"])
    return found.select(F.concat_ws("|", "initial", "final").alias("a"), F.concat_ws("|", "other_initial", "other_final").alias("b"))


def _only(text: Column | str, character: str) -> Column:
    return F.regexp_replace(text, f"[^{character[1:-1]}]", "")


def _letters(text: Column | str) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def _sounds(terms: DataFrame, syllables: DataFrame, character: str) -> DataFrame:
    """(term, t, n, offset, a): the syllables that sound like each position of a term of 2-6 characters."""
    said = syllables.select("ch", F.concat_ws("|", "initial", "final").alias("b"))
    short = terms.select("term", _only("term", character).alias("t")).where(F.length("t").between(2, 6)).distinct()
    cells = short.select("term", "t", F.length("t").alias("n"), F.posexplode(_letters("t")).alias("offset", "ch")).join(said, "ch")
    return cells.join(near_syllables(syllables), "b").select("term", "t", "n", "offset", "a")


def _class_of(characters: list[str]) -> str:
    return "[" + "".join(c if c.isalnum() else "\\" + c for c in sorted(characters)) + "]"


def near_homophone_hits(segments: DataFrame, terms: DataFrame, syllables: DataFrame, character: str = CJK, max_terms: int = 200, max_syllables: int = 50_000) -> DataFrame:
    """K3: (doc_id, seg_no, term, start): windows of a term's length (2-6) that sound like it, position by position, in
    segments that don't hold the term itself. Only characters of the class count. syllables (ch, initial, final).

    While terms and syllables are few (both counted first), each term is a pattern with a class of characters for each
    position, and the scan finds its starts without a shuffle; beyond that, positions are joined.
    """
    few = terms.select("term").distinct().limit(max_terms + 1).count() <= max_terms and syllables.limit(max_syllables + 1).count() <= max_syllables
    return _hits_by_pattern(segments, terms, syllables, character) if few else _hits_by_join(segments, terms, syllables, character)


def _hits_by_pattern(segments: DataFrame, terms: DataFrame, syllables: DataFrame, character: str) -> DataFrame:
    said = syllables.select("ch", F.concat_ws("|", "initial", "final").alias("a"))
    # max_terms x 6 rows, each with characters of the bounded table.
    rows = _sounds(terms, syllables, character).join(said, "a").groupBy("term", "t", "n", "offset").agg(F.collect_set("ch").alias("chars")).collect()
    sounds: dict[tuple[str, str], dict[int, str]] = {}
    for r in rows:
        sounds.setdefault((r["term"], r["t"]), {})[r["offset"]] = _class_of(r["chars"])

    def starts(text: Column, pattern: str) -> Column:
        # Cut before every start: all pieces but the first begin with a hit, and the first does if the text does.
        ends = lambda parts: F.aggregate(parts, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(0)) + F.length(x))))
        cuts = F.get(F.transform(F.array(F.split(text, f"(?={pattern})")), lambda p: ends(F.slice(p, 1, F.size(p) - 1))), F.lit(0))
        return F.concat(F.when(text.rlike("^" + pattern), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), cuts)

    own = segments.select("doc_id", "seg_no", _only("text", character).alias("plain"))
    found = []
    for (term, t), at in sorted(sounds.items()):
        if len(at) == len(t):
            pattern = "".join(at[i] for i in range(len(t)))
            hit = ~F.contains("plain", F.lit(t)) & F.col("plain").rlike(pattern)
            found.append(F.when(hit, F.struct(F.lit(term).alias("term"), starts(F.col("plain"), pattern).alias("starts"))))
    if not found:
        return own.where(F.lit(False)).select("doc_id", "seg_no", F.lit("").alias("term"), F.lit(0).alias("start"))
    hits = own.select("doc_id", "seg_no", F.explode(F.array_compact(F.array(*found))).alias("hit"))
    return hits.select("doc_id", "seg_no", "hit.term", F.explode("hit.starts").alias("start"))


def _hits_by_join(segments: DataFrame, terms: DataFrame, syllables: DataFrame, character: str) -> DataFrame:
    said = syllables.select("ch", F.concat_ws("|", "initial", "final").alias("a"))
    own = segments.select("doc_id", "seg_no", _only("text", character).alias("plain"))
    heard = own.select("doc_id", "seg_no", F.posexplode(_letters("plain")).alias("pos", "ch")).join(said, "ch").select("doc_id", "seg_no", "pos", "a")
    hits = _sounds(terms, syllables, character).join(heard, "a").select("doc_id", "seg_no", "term", "t", "n", (F.col("pos") - F.col("offset")).alias("start"), "offset")
    whole = hits.groupBy("doc_id", "seg_no", "term", "t", "n", "start").agg(F.count_distinct("offset").alias("found")).where("found = n and start >= 0")
    return whole.join(own, ["doc_id", "seg_no"]).where(~F.contains("plain", F.col("t"))).select("doc_id", "seg_no", "term", "start")


OPCODES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("tag", "old", "new")]))


@F.pandas_udf(OPCODES)
def opcodes(original: pd.Series, candidate: pd.Series, most: pd.Series) -> pd.Series:
    """The differences of two texts as (tag, old, new), in order; what is equal stands in ``old`` alone. Null for nulls, and for
    texts that differ by more than ``most`` characters."""

    def one(a: str | None, b: str | None, n: float) -> list[dict] | None:
        found = None if a is None or b is None else opcodes_within(a, b, int(n))
        return found and [{"tag": t, "old": a[i:j], "new": "" if t == "equal" else b[k:m]} for t, i, j, k, m in found]

    return pd.Series([one(*row) for row in zip(original, candidate, most, strict=True)], dtype=object)


def changed_share(ops: Column, original: Column) -> Column:
    changed = F.aggregate(F.filter(ops, lambda o: o["tag"] != "equal"), F.lit(0), lambda a, o: a + F.greatest(F.length(o["old"]), F.length(o["new"])))
    return F.coalesce(F.try_divide(changed.cast("double"), F.length(original).cast("double")), F.lit(0.0))


def sounding_alike(syllables: DataFrame, swaps: DataFrame) -> DataFrame:
    """Of (old, new) those of equal length, all of known characters, whose syllables are near one by one."""
    said = syllables.select("ch", F.concat_ws("|", "initial", "final").alias("syllable"))
    near = near_syllables(syllables)
    fit = swaps.where((F.length("old") == F.length("new")) & (F.length("old") > 0)).distinct()
    split = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    each = fit.select("old", "new", F.explode(F.arrays_zip(split("old").alias("o"), split("new").alias("n"))).alias("z")).select("old", "new", F.col("z.o").alias("o"), F.col("z.n").alias("n"))
    left = said.select(F.col("ch").alias("o"), F.col("syllable").alias("a"))
    right = said.select(F.col("ch").alias("n"), F.col("syllable").alias("b"))
    judged = each.join(left, "o", "left").join(right, "n", "left").join(near.withColumn("near", F.lit(True)), ["a", "b"], "left")
    return judged.groupBy("old", "new").agg(F.bool_and(F.coalesce("near", F.lit(False))).alias("alike")).where("alike").select("old", "new")


def gate_corrections(pairs: DataFrame, syllables: DataFrame, glossary: DataFrame, ratio: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """K4: pairs (doc_id, seg_no, original, candidate) to (gated texts, changes).

    A candidate that changes more than ``ratio`` is dropped whole. Replacements stay if they sound alike or are in the
    glossary (wrong, right); other replacements, insertions and deletions are undone, but for inserted white space.
    Texts that surely differ too much get no alignment; the others' is difflib's.
    """
    # A null on one side counts as no change.
    same = F.coalesce(stripped(F.col("original")) == stripped(F.col("candidate")), F.lit(True))
    # An empty text has no share that could be too large. One more than the share allows leaves no doubt from rounding.
    most = F.when(F.col("original") == "", F.length("candidate")).otherwise(F.floor(F.length("original") * ratio) + 1).cast("int")
    ops = opcodes(F.when(~F.col("same"), F.col("original")), F.when(~F.col("same"), F.col("candidate")), most)
    cut = pairs.withColumn("same", same).withColumn("ops", ops)
    dropped = ~F.col("same") & (F.col("ops").isNull() | (changed_share(F.col("ops"), F.col("original")) > ratio))
    told = cut.withColumn("dropped", dropped).withColumn("ops", F.when(~F.col("dropped"), F.col("ops")))
    # Written, as both results and the swaps come from it; a text that has operations is in them. Keys may be there twice.
    held = materialised(told.select(F.monotonically_increasing_id().alias("row"), "doc_id", "seg_no", F.when(F.col("ops").isNull(), F.col("original")).alias("original"), "ops", "dropped"), "differences")
    each = held.select("row", "doc_id", "seg_no", F.posexplode("ops").alias("op_no", "o")).select("row", "doc_id", "seg_no", "op_no", "o.*").where("tag <> 'equal'")
    swaps = each.where("tag = 'replace'").select("old", "new").distinct()
    good = sounding_alike(syllables, swaps).unionByName(glossary.select(F.col("wrong").alias("old"), F.col("right").alias("new"))).distinct().withColumn("good", F.lit(True))
    judged = each.join(good, ["old", "new"], "left")
    accepted = (F.col("tag") == "replace") & F.coalesce("good", F.lit(False))
    taken = judged.where(accepted).groupBy("row").agg(F.collect_set("op_no").alias("taken"))

    def gated(taken: Column) -> Column:
        def kept(o: Column, i: Column) -> Column:
            insert = F.when(stripped(o["new"]) == "", o["new"]).otherwise("")
            swap = F.when(F.coalesce(F.array_contains(taken, i), F.lit(False)), o["new"]).otherwise(o["old"])
            return F.when(o["tag"] == "insert", insert).when(o["tag"] == "replace", swap).otherwise(o["old"])

        return F.coalesce(F.array_join(F.transform("ops", kept), ""), "original").alias("text")

    # Only texts with a replacement meet the judged ones.
    swapped = F.coalesce(F.exists("ops", lambda o: o["tag"] == "replace"), F.lit(False))
    out = held.where(~swapped).select("doc_id", "seg_no", gated(F.array().cast("array<int>")), "dropped")
    out = out.unionByName(held.where(swapped).join(taken, "row", "left").select("doc_id", "seg_no", gated(F.col("taken")), "dropped"))
    blank = lambda c: stripped(F.col(c)) == ""
    reported = (F.col("tag") == "replace") | ((F.col("tag") == "delete") & ~blank("old")) | ((F.col("tag") == "insert") & ~blank("new"))
    reason = F.when(accepted, "").when(F.col("tag") == "replace", "not alike").when(F.col("tag") == "delete", "deletion").otherwise("insertion")
    changes = judged.where(reported).select("doc_id", "seg_no", "op_no", F.col("old").alias("original"), F.col("new").alias("corrected"), accepted.alias("accepted"), reason.alias("reason"))
    whole = held.where("dropped").select("doc_id", "seg_no", F.lit(-1).alias("op_no"), F.lit("").alias("original"), F.lit("").alias("corrected"), F.lit(False).alias("accepted"), F.lit("changes too much").alias("reason"))
    return out, changes.unionByName(whole)


def correction_report(changes: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K5: (totals per document, accepted pairs in the order first seen)."""
    per = changes.groupBy("doc_id", "seg_no").agg(F.bool_or("accepted").alias("any_ok"), F.bool_or(F.col("op_no") == -1).alias("whole"))
    counts = per.groupBy("doc_id").agg(F.count_if("any_ok").alias("segments_corrected"), F.count_if(F.col("whole") & ~F.col("any_ok")).alias("segments_discarded"))
    totals = segments.groupBy("doc_id").agg(F.count("*").alias("segments_total")).join(counts, "doc_id", "left").na.fill(0)
    first = changes.where("accepted").groupBy("doc_id", "original", "corrected").agg(F.min(F.struct("seg_no", "op_no")).alias("at"))
    ranked = first.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("at"))).drop("at")
    return totals, ranked


def preceding_context(segments: DataFrame, chars: int = 60) -> DataFrame:
    """K6: adds ``context``: the last characters before the segment, of the uncorrected text."""
    w = W.partitionBy("doc_id").orderBy("seg_no")
    # Segments before that can matter: at least one character each, so no more than ``chars`` of them.
    before = F.array_join(F.collect_list("text").over(w.rowsBetween(-chars, -1)), "")
    return segments.withColumn("context", F.right(before, F.lit(chars)))


def hotword_prefix(terms: DataFrame, budget: int = 300) -> DataFrame:
    """K7: per scope the longest run of first terms whose lengths, each with a separator, stay within the budget."""
    w = W.partitionBy("scope").orderBy("ord")
    kept = terms.withColumn("upto", F.sum(F.length("term") + 1).over(w)).where(F.col("upto") <= budget)
    return kept.groupBy("scope").agg(F.count("*").alias("n_terms"), in_order("ord", "term", " ").alias("hotwords"))


def glossary_block(terms: DataFrame, pairs: DataFrame, n_terms: int = 200, n_pairs: int = 50) -> DataFrame:
    """K7: per scope the first terms and pairs as a listing."""
    t = terms.where(F.col("ord") <= n_terms).groupBy("scope").agg(in_order("ord", "term", "、").alias("terms"))
    p = pairs.where(F.col("ord") <= n_pairs).groupBy("scope").agg(in_order("ord", F.concat("wrong", F.lit("→"), "right"), "、").alias("pairs"))
    return t.join(p, "scope", "full").select("scope", F.concat_ws("\n", "terms", "pairs").alias("block"))


def union_glossaries(global_terms: DataFrame, template_terms: DataFrame) -> DataFrame:
    """K8: (scope, ord, term) of each template scope: the global terms and then its own, the first of equal ones."""
    scopes = sorted(r["scope"] for r in template_terms.select("scope").distinct().limit(MAX_ALTERNATIVES + 1).collect())  # the template registry
    if len(scopes) > MAX_ALTERNATIVES:
        raise ValueError(f"more than {MAX_ALTERNATIVES} scopes")
    named = F.array(*[F.lit(s) for s in scopes]).cast("array<string>")
    shared = global_terms.select(F.explode(named).alias("scope"), "term", F.col("ord").alias("o"), F.lit(0).alias("side"))
    both = shared.unionByName(template_terms.select("scope", "term", F.col("ord").alias("o"), F.lit(1).alias("side")))
    first = both.groupBy("scope", "term").agg(F.min(F.struct("side", "o")).alias("at"))
    return numbered(first, ["scope"], ["at"], "ord").select("scope", "ord", "term")


def english_terms(terms: DataFrame) -> DataFrame:
    """K9: terms with a Latin letter."""
    return terms.where(F.col("term").rlike("[A-Za-z]"))


def protected_terms(terms: DataFrame, most: int = MAX_ALTERNATIVES) -> list[str]:
    """K9 for C6: the terms that keep an English line, as a list of checked size."""
    rows = english_terms(terms).select("term").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} protected terms")
    return sorted(r["term"] for r in rows)


def circuit_break(results: DataFrame) -> DataFrame:
    """Results (doc_id, seg_no, text, candidate, error): after a document's first stable error (code in capitals),
    later segments keep their source text; the failed one does too."""
    w = W.partitionBy("doc_id").orderBy("seg_no").rowsBetween(W.unboundedPreceding, 0)
    stable = F.coalesce(F.col("error").rlike("^[A-Z_]+$"), F.lit(False))
    broken = F.max(stable).over(w)
    text = F.when(broken | F.col("error").isNotNull() | (stripped(F.coalesce("candidate", F.lit(""))) == ""), F.col("text")).otherwise(F.col("candidate"))
    return results.withColumn("broken", broken).withColumn("final", text).drop("candidate")

