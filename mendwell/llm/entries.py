"""Free-typed screen names to the entries of a catalog.

A step is read into its effect (open, on, off) and the name it gives. Each distinct token of the names is repaired first:
it is joined to the catalog's tokens by their deletion neighbourhoods (long tokens: by whole parts) and kept where the edit distance is small (also
to two neighbouring tokens typed as one, and to the token it abbreviates). The repaired tokens then meet the names through an
inverted index of each name's rarest words, and soft TF-IDF ranks the complete names. A name leads to the entry of the step's effect.

All joins are on equal keys over distinct names and tokens; a step that occurs a million times is resolved once.

Defined results
    * null and blank steps, steps that name nothing, and names under the acceptance score: entry 0.
    * the placeholder (an entry without an effect) is never an answer.
    * ties of the score go to the smaller entry id; several entries of one name and effect likewise.
    * empty catalog: every step gets 0; empty steps: no rows. Repeated rows come out once each. Extra columns
      of the steps are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import cut

#: Least soft TF-IDF of an accepted name.
ACCEPT = 0.71
#: Similarity of an abbreviation to its word.
ABBREVIATED = 0.9
#: The effects of the catalog's types.
EFFECTS = {"onClickURL": "open", "onURL": "on", "offURL": "off"}
#: Most deleted letters on either side of a token join.
EDITS = 2
#: Tokens of more letters meet by whole parts instead of deletions, and the parts of such a word.
LONG, PARTS = 16, 5


def _plain(text: Column) -> Column:
    """Lower case, white space and marks between words as single spaces, final marks gone."""
    s = F.regexp_replace(F.lower(text), "[\\s\u00a0\u200b\ufeff]+", " ")
    return F.regexp_replace(F.regexp_replace(s, r"^[\s\d.)*\-]+(?=[a-z])", ""), r"[\s.!?;:,]+$", "")


def effect(step: Column) -> Column:
    """What a step does to the screen it names."""
    s = _plain(step)
    off = s.rlike(r"\b(?:disable|deactivate|switch off|turn off|toggle off|shut off)\b|\b(?:switch|turn|set|toggle|put)\b.* (?:to )?off(?: please)?$")
    on = s.rlike(r"\b(?:enable|activate|switch on|turn on|toggle on)\b|\b(?:switch|turn|set|toggle|put)\b.* (?:to )?on(?: please)?$")
    return F.when(off, "off").when(on, "on").otherwise("open")


def name(step: Column) -> Column:
    """The screen's name as typed: the end of a path, without verbs, area and courtesy; empty where a step isn't about a screen."""
    s = F.regexp_replace(_plain(step), r"^(?:please |kindly |then |now |next |make sure to |be sure to |you can )+|(?: please| for me)+$", "")
    s = F.regexp_replace(s, r"[\s.!?;:,]+$", "")
    path = F.when(s.rlike(r"^(?:go to |open |navigate to )?settings ?[>/]"), F.regexp_replace(F.element_at(F.split(s, "[>/]"), -1), "^ +", ""))
    then = F.when(s.rlike(r"^from (?:the )?settings.* then "), F.regexp_extract(s, r"^.* then (?:tap on |open |choose )?(.*)$", 1))
    toggled = F.regexp_extract(s, r"^(?:switch|turn|set|toggle|put) (?:on |off )?(.*?)(?: to)?(?: on| off)?$", 1)
    asked = F.regexp_extract(s, r"^(?:open up|open|go to|navigate to|tap on|tap|look up|search for|find|visit|show|view|enable|disable|activate|deactivate|select|choose) (.*)$", 1)
    body = F.coalesce(path, then, F.when(toggled != "", toggled), F.when(asked != "", asked), F.lit(""))
    body = F.regexp_replace(body, r" in (?:the |device )?settings(?: app| menu)?(?: and (?:open|tap|choose|select) it)?$| in (?:the )?\S+(?: section of)? settings$| under \S+$| on (?:the|your|this) (?:device|phone|tablet)$", "")
    return F.regexp_replace(body, r"^(?:the|your|my) ", "")


def tokens(text: Column) -> Column:
    """Words of a name; an abbreviating stop stays with its word."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?=\.)|(?<![\p{L}])\.", " "), " +"), lambda t: t != "")


def catalog_names(catalog: DataFrame) -> DataFrame:
    """(link_id, effect, name): the name and by-name of each entry, from its description and its message."""
    c = catalog.select("link_id", F.col("original_type").alias("kind"), "description", "message")
    kinds = F.create_map(*(F.lit(x) for kv in EFFECTS.items() for x in kv))
    c = c.withColumn("effect", F.element_at(kinds, F.col("kind"))).filter(F.col("effect").isNotNull())
    d = _plain(F.col("description"))
    d = F.regexp_replace(d, r"^(?:shows|leads to|opens the|opens|turns on|turns off|turns|switches|enables|disables) ", "")
    d = F.regexp_replace(d, r" (?:in the \S+ section of settings|in device settings|under \S+|on the device|in settings)$", "")
    d = F.when(_plain(F.col("description")).rlike("^switches "), F.regexp_replace(d, r" (?:on|off)$", "")).when(_plain(F.col("description")).rlike("^opens the "), F.regexp_replace(d, r" screen$", "")).otherwise(d)
    by = F.regexp_extract(d, r"\(([^)]*)\)", 1)
    own = F.regexp_replace(d, r"\s*\([^)]*\)", "")
    said = F.regexp_replace(_plain(F.coalesce("message", F.lit(""))), r"^(?:view|enable|disable) ", "")
    return c.select("link_id", "effect", F.explode(F.array_distinct(F.array(own, by, said))).alias("name")).filter(F.size(tokens(F.col("name"))) > 0)


def _deletions(token: Column) -> Column:
    """The token and what is left of it without one or two letters; short ones lose one at most, long ones aren't met this way."""

    def without(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(t.substr(F.lit(1), i - 1), t.substr(i + 1, F.length(t))))

    none = F.array().cast("array<string>")
    one = without(token)
    two = F.when(F.length(token) > 4, F.flatten(F.transform(one, without))).otherwise(none)
    met = F.array_distinct(F.concat(F.array(token), F.when(F.length(token) > 1, one).otherwise(none), two))
    return F.when(F.length(token) <= LONG + EDITS, met).otherwise(none)


def _segments(token: Column, typed: bool) -> Column:
    """Keys by which long tokens meet: the word is cut into five parts, of which two edits (swaps of neighbours among them) leave one whole.

    A key is (length of the word, number of the part, its letters); a typed token gives those of all words it could be, with each part moved by
    up to two letters. The keys grow with the token's length and not with its square.
    """

    def part(n: Column, i: Column, move: Column | int) -> Column:
        start, end = F.floor(n * i / PARTS), F.floor(n * (i + 1) / PARTS)
        at = start + move
        inside = (at >= 0) & (at + (end - start) <= F.length(token))
        return F.when(inside, F.concat_ws(":", n, i, token.substr((at + 1).cast("int"), (end - start).cast("int"))))

    numbers = F.sequence(F.lit(0), F.lit(PARTS - 1))
    if not typed:
        keys = F.transform(numbers, lambda i: part(F.length(token), i, 0))
    else:
        moves = F.sequence(F.lit(-EDITS), F.lit(EDITS))
        keys = F.flatten(F.transform(moves, lambda d: F.flatten(F.transform(numbers, lambda i: F.transform(moves, lambda m: part(F.length(token) + d, i, m))))))
    return F.when(F.length(token) > LONG, F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).otherwise(F.array().cast("array<string>"))


def _letters(token: Column) -> Column:
    return F.array_join(F.array_sort(F.split(token, "")), "")


def repaired(typed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, similarity): distinct typed tokens and the catalog's words within their edit distance; a swap of neighbours is one edit."""
    cut_short = typed.filter(F.col("token").endswith(".")).select("token", F.regexp_replace("token", r"\.", "").alias("stem")).filter(F.length("stem") >= 2)
    heads = vocabulary.select("word", F.explode(F.transform(F.sequence(F.lit(2), F.length("word")), lambda i: F.col("word").substr(F.lit(1), i))).alias("stem")).filter(F.length("stem") < F.length("word"))
    short = cut_short.join(heads, "stem").select("token", "word", F.lit(ABBREVIATED).alias("similarity"))
    a = typed.select("token", F.regexp_replace("token", r"\.", "").alias("bare")).filter("bare <> ''")
    left = a.select("token", "bare", F.explode(F.concat(_deletions(F.col("bare")), _segments(F.col("bare"), True))).alias("part"))
    right = vocabulary.select("word", F.explode(F.concat(_deletions(F.col("word")), _segments(F.col("word"), False))).alias("part"))
    met = left.join(right, "part").select("token", "bare", "word").distinct()
    n, sorted_n = F.levenshtein("bare", "word"), F.levenshtein(_letters(F.col("bare")), _letters(F.col("word")))
    # two edits, of which one or both are swaps, show as three or four of the plain distance
    edits = F.when((n == 2) & (sorted_n == 0), 1).when((n == 3) & (sorted_n <= 2) | (n == 4) & (sorted_n == 0), 2).otherwise(n)
    longest = F.greatest(F.length("bare"), F.length("word"))
    most = F.when(longest <= 2, 0).when(longest <= 4, 1).otherwise(EDITS)
    near = met.withColumn("edits", edits).filter(F.col("edits") <= most).select("token", "word", (1 - F.col("edits") / longest).alias("similarity"))
    return near.unionByName(short).groupBy("token", "word").agg(F.max("similarity").alias("similarity"))


def resolve(steps: DataFrame, step: str, catalog: DataFrame) -> DataFrame:
    """The steps with the id of the entry each leads to (link_id, 0 for none)."""
    entries = cut(catalog_names(catalog))  # a few names for each entry, read by many joins
    names = entries.select("name").distinct().withColumn("words", tokens(F.col("name")))
    index = names.select("name", F.explode("words").alias("word")).groupBy("name", "word").agg(F.count("*").alias("times"))
    total = names.agg(F.count("*").alias("n_names"))
    weight = cut(index.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("word", F.log(1 + F.col("n_names") / F.col("df")).alias("idf")))  # one row of totals
    mass = F.col("idf") * F.col("idf")
    holds = index.join(weight, "word").withColumn("name_norm", F.sqrt(F.sum(mass * F.col("times")).over(Window.partitionBy("name")))).withColumn("n_words", F.count("*").over(Window.partitionBy("name")))
    # a name is accepted only if its matched words hold ACCEPT squared of its weight, so one of those words must be among its rarest ones,
    # the others of which hold less: common words bring no pair together that isn't brought by a rare one
    so_far = F.sum(mass).over(Window.partitionBy("name").orderBy("idf", "word"))
    holds = cut(holds.withColumn("rare", so_far >= (ACCEPT * F.col("name_norm")) ** 2 - 1e-9).select("name", "word", "idf", "name_norm", "n_words", "rare"))
    rarest = F.log(1 + 2 * F.col("n_names"))
    joined = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(F.concat(F.get("words", i - 1), F.get("words", i)).alias("word"), F.array(F.get("words", i - 1), F.get("words", i)).alias("parts")))
    pairs = names.filter(F.size("words") > 1).select(F.explode(joined).alias("p")).select("p.word", "p.parts").distinct()
    singles = weight.select("word", F.array("word").alias("parts"))
    vocabulary = cut(singles.unionByName(pairs))

    distinct = steps.select(F.col(step).alias("typed")).filter(F.col("typed").isNotNull()).groupBy("typed").agg(F.count("*").alias("n_rows")).drop("n_rows")
    read = cut(distinct.select("typed", effect(F.col("typed")).alias("effect"), name(F.col("typed")).alias("said")))
    said = read.select("said").distinct().select("said", F.posexplode(tokens(F.col("said"))).alias("at", "token"))
    fixed = cut(repaired(said.select("token").distinct(), vocabulary.select("word").distinct()))
    words = said.join(fixed, "token").join(vocabulary, "word").select("said", "at", F.explode("parts").alias("word"), "similarity")
    near = words.join(holds.filter("rare"), "word").select("said", "name").distinct()
    best = near.join(words, "said").join(holds, ["name", "word"]).groupBy("said", "name", "at", "word").agg(F.max("similarity").alias("similarity"), *(F.first(c).alias(c) for c in ("idf", "name_norm", "n_words")))
    score = best.withColumn("rank", F.row_number().over(Window.partitionBy("said", "name", "word").orderBy(F.col("similarity").desc(), "at"))).filter("rank = 1")
    met = score.groupBy("said", "name").agg(F.sum(F.col("similarity") * F.col("idf") * F.col("idf")).alias("dot"), F.sum(F.col("idf") * F.col("idf")).alias("mass"), F.countDistinct("at").alias("used"), F.count("*").alias("held"), F.first("name_norm").alias("name_norm"), F.first("n_words").alias("n_words"))
    sizes = said.groupBy("said").agg(F.count("*").alias("n"))
    ranked = met.join(sizes, "said").crossJoin(F.broadcast(total)).withColumn(
        "score", F.col("dot") / (F.col("name_norm") * F.sqrt(F.col("mass") + (F.col("n") - F.col("used")) * rarest * rarest / 4))
    ).filter((F.col("score") >= ACCEPT) & (F.col("n_words") - F.col("held") <= F.col("n") - F.col("used")))  # a word of the name is missing only where a strange one stands for it
    led = ranked.join(read, "said").join(entries, ["name", "effect"])
    top = led.withColumn("rank", F.row_number().over(Window.partitionBy("typed").orderBy(F.round("score", 9).desc(), "link_id"))).filter("rank = 1").select(F.col("typed").alias(step), "link_id")
    return steps.join(top, step, "left").withColumn("link_id", F.coalesce("link_id", F.lit(0).cast("bigint")))
