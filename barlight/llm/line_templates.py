"""Line deduplication with a log-template tree; DataFrame functions only.

Lines are parsed by a tree of fixed depth: number of tokens, then the leading tokens, with tokens that hold a digit as variable fields. Lines that
end in the same leaf are compared position by position: a token that most of the leaf's different lines share is constant, and a line of which
nearly all tokens are constant belongs to the leaf's template, in which the other positions are variable. Any other line is a template of its own.

A template that recurs across documents is dropped from all of them. Copies of whole documents are not recurrence: a template recurs if several texts
hold it of which no two are near copies. Two texts are near copies if the lines that only one of them holds are made of much the same word pairs as the
other text. So what surrounds a template inside a shared passage doesn't matter, nor how many near copies hold it.

Only hashes of lines are shuffled, and the lines of leaves that hold several; texts move once, to meet the positions that go. All groupings pre-aggregate, so a line that a third of all
documents hold is one row for each split before it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.session import durable

LEADING = 3
MIN_TEXTS = 3
"""So many texts, no two of them near copies, hold a template that recurs."""
LONG = 20
"""Templates of so many tokens don't recur by chance: two such texts are enough."""
CONSTANT_SHARE = 0.8
BITMAP = 1 << 22
MIN_TOKENS = 5
"""Shorter lines are their own templates: too few tokens to tell constants from variables."""
PROBES = 8
FIRST = 5
"""Texts of a template that are compared first."""
SKETCH = 12
"""Hashed word pairs kept of each line, the smallest; the first PROBES of a line are looked up among all of the other text."""
NEAR = 0.55
LIKE_SIZE = 0.6
"""Share of the longer text's length from which on a text that is held by the other counts as its near copy."""


def masked(line: Column) -> Column:
    """Tokens with one space between them; a token with a digit is a variable field."""
    fields = lambda tidy: F.regexp_replace(tidy, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")  # noqa: E731 - from a token's start, so that no token is read twice
    spaced = line.startswith(" ") | line.endswith(" ") | line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\f") | line.contains("\x0b")
    tidy = F.trim(F.regexp_replace(line, "[ \\t\\r\\f\\x0b]+", " "))
    return F.when(spaced, fields(tidy)).when(line.rlike("[0-9]"), fields(line)).otherwise(line)


def parsed_lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a token of each text: text key (h, size), number of lines, position, masked line, its hash, tokens and leaf."""
    lines = F.split("text", "\n")
    texts = docs.filter("text is not null").select(F.xxhash64("text").alias("h"), F.length("text").alias("size"), lines.alias("lines"))
    parts = texts.select("h", "size", F.size("lines").alias("total"), F.posexplode("lines").alias("position", "line")).filter(F.btrim("line", F.lit(" \t\r\f\x0b")) != "")
    # The generator keeps the optimizer from copying what it makes into every expression and filter above.
    parts = parts.select("h", "size", "total", "position", F.explode(F.array(masked(F.col("line")))).alias("mask"))
    tokens = F.octet_length("mask") - F.octet_length(F.replace("mask", F.lit(" "), F.lit(""))) + 1
    return parts.withColumns({"event": F.xxhash64("mask"), "tokens": tokens, "leaf": F.xxhash64(tokens, F.substring_index("mask", " ", LEADING))})


def maybe_among(rows: DataFrame, hashes: DataFrame, name: str) -> DataFrame:
    """The rows whose column *name* may be among *hashes* (same name). The bitmap has a fixed size and goes to all tasks as a table of its words, not
    as a constant, which every description of the plan would repeat on the driver."""
    at = F.pmod(name, F.lit(BITMAP))
    words = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("_mask"))
    here = (F.shiftright(at, 5) == F.col("_word")) & (F.col("_mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))) != 0)
    return rows.join(F.broadcast(words), here, "left_semi")


def leaf_templates(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(event, template) of the lines that belong to the template of a leaf that holds several different lines."""
    several = facts.filter(F.col("tokens") >= MIN_TOKENS).groupBy("leaf").agg(F.min("event").alias("low"), F.max("event").alias("high")).filter("low != high").select("leaf")
    several = durable(several)
    lines = parsed_lines(docs).select("mask", F.explode(F.array(F.struct("leaf", "event", "tokens"))).alias("key")).select("mask", "key.*")
    lines = maybe_among(lines.filter(F.col("tokens") >= MIN_TOKENS), several, "leaf").select("leaf", "event", "mask")
    events = durable(lines.distinct().join(several, "leaf").groupBy("leaf", "event").agg(F.max("mask").alias("mask")))
    tokens = events.select("leaf", "event", F.posexplode(F.split("mask", " ")).alias("place", "token"))
    counts = tokens.groupBy("leaf", "place", "token").agg(F.count("*").alias("n"))
    sizes = events.groupBy("leaf").agg(F.count("*").alias("all"))
    constant = counts.filter("n >= 2").join(sizes, "leaf").filter("2 * n > all").select("leaf", "place", "token")
    shares = tokens.join(constant.withColumn("same", F.lit(1)), ["leaf", "place", "token"], "left").groupBy("leaf", "event").agg((F.count("same") / F.count("*")).alias("share"))
    return shares.filter(F.col("share") >= CONSTANT_SHARE).select("event", F.col("leaf").alias("template"))


def line_sketches(docs: DataFrame, held: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts *wanted* (h, size): the smallest hashed word pairs of each line by position, and the templates that *held* finds at positions."""
    pairs = lambda words: F.transform(words, lambda w, i: F.hash(w, F.coalesce(F.get(words, i + 1), F.lit(""))))
    sketch = lambda line: F.get(F.transform(F.array(F.split(masked(line), " ")), lambda words: F.slice(F.sort_array(pairs(words)), 1, SKETCH)), 0)
    blank = lambda line: F.btrim(line, F.lit(" \t\r\f\x0b")) == ""
    asked = maybe_among(held, wanted, "h").groupBy("h", "size").agg(F.collect_set(F.struct("position", "template")).alias("held")).join(wanted, ["h", "size"], "left_semi")
    texts = maybe_among(docs.filter("text is not null").select(F.xxhash64("text").alias("h"), F.length("text").alias("size"), "text"), wanted, "h")
    lines = F.transform(F.split("text", "\n"), lambda line: F.when(blank(line), F.array().cast("array<int>")).otherwise(sketch(line)))
    return durable(texts.select("h", "size", lines.alias("sketches")).dropDuplicates(["h", "size"]).join(asked, ["h", "size"]))


def recurring(docs: DataFrame, held: DataFrame) -> DataFrame:
    """Templates of *held* (template, h, size, total, position, tokens) that recur across documents: (template).

    Most that recur show it among their FIRST texts of most lines, which are compared first; templates that don't, and have more texts, are judged on
    all of them. Both judge alike, as a text that comes later never takes the place of one of most lines.
    """
    left = durable(held.groupBy("template", "h", "size").agg(F.max("total").alias("total"), F.max("tokens").alias("tokens")))
    place = F.row_number().over(Window.partitionBy("template").orderBy(F.desc("total"), F.desc("h"), F.desc("size")))
    first = durable(left.withColumn("place", place).filter(F.col("place") <= FIRST + 1))
    sizes = durable(first.groupBy("template").agg(F.count("*").alias("n"), F.max("tokens").alias("tokens")).filter((F.col("n") >= MIN_TEXTS) | (F.col("tokens") >= LONG)))
    early = durable(unlike_texts(docs, held, first.filter(F.col("place") <= FIRST).drop("place").join(sizes.select("template"), "template", "left_semi")))
    open_ones = sizes.filter(F.col("n") > FIRST).join(early, "template", "left_anti").select("template")
    return early.union(unlike_texts(docs, held, left.join(open_ones, "template", "left_semi")))


def unlike_texts(docs: DataFrame, held: DataFrame, left: DataFrame) -> DataFrame:
    """Templates of *left* (template, h, size, total, tokens) that enough texts of it hold of which no two are near copies: (template).

    Each round takes a text of every template, the one of most lines, and puts the texts that are no near copies of it to the next round.
    """
    left = durable(left)
    texts = line_sketches(docs, held, durable(left.select("h", "size").distinct()))
    left = apart(left, texts)
    two = (F.col("tokens") >= LONG) & F.col("unlike")
    found = left.filter(two).select("template")
    left = left.filter(~two)
    for _ in range(MIN_TEXTS - 2):
        left = apart(left.drop("unlike"), texts)
    return found.union(left.select("template")).distinct()


def apart(left: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of *left* (template, h, size, total, tokens) whose texts are no near copies of their template's text of most lines.

    Near copies hold most of each other's own lines; of texts of like size one direction is enough, so a shortened copy is one, but not a text that
    a digest quotes among others. Column unlike tells texts of which neither holds the other's lines.
    """
    lead = left.groupBy("template").agg(F.max(F.struct("total", "h", "size")).alias("lead"))
    led = durable(left.join(lead, "template").select("template", "h", "size", "total", "tokens", F.col("lead.h").alias("h2"), F.col("lead.size").alias("size2")).filter("h != h2 or size != size2"))
    first = texts.select("h", "size", F.col("sketches").alias("x"), F.col("held").alias("x_held"))
    second = texts.select(F.col("h").alias("h2"), F.col("size").alias("size2"), F.col("sketches").alias("y"), F.col("held").alias("y_held"))
    pairs = led.select("h", "size", "h2", "size2").distinct().join(first, ["h", "size"]).join(second, ["h2", "size2"])
    common = F.array_intersect(F.transform("x_held", lambda v: v["template"]), F.transform("y_held", lambda v: v["template"]))
    pairs = pairs.withColumn("common", F.explode(F.array(common)))
    for side in ("x", "y"):
        known = F.transform(F.filter(f"{side}_held", lambda v: F.array_contains("common", v["template"])), lambda v: v["position"])
        pairs = pairs.withColumn(f"{side}_known", F.explode(F.array(known)))
    unknown = lambda known: lambda line, i: ~F.array_contains(known, i)
    for side in ("x", "y"):
        own = F.transform(F.filter(side, unknown(f"{side}_known")), lambda line: F.slice(line, 1, PROBES))
        pairs = pairs.withColumn(f"{side}_own", F.explode(F.array(F.array_distinct(F.flatten(own)))))
    found = lambda own, other: F.size(F.array_intersect(own, F.flatten(other))) >= NEAR * F.size(own)
    alike = F.least("size", "size2") >= LIKE_SIZE * F.greatest("size", "size2")
    pairs = pairs.select("h", "size", "h2", "size2", alike.alias("alike"), found("x_own", "y").alias("x_in"), found("y_own", "x").alias("y_in"))
    far = pairs.filter(~((F.col("x_in") & F.col("y_in")) | (F.col("alike") & (F.col("x_in") | F.col("y_in"))))).withColumn("unlike", ~(F.col("x_in") | F.col("y_in"))).drop("alike", "x_in", "y_in")
    return durable(led.join(durable(far), ["h", "size", "h2", "size2"]).select("template", "h", "size", "total", "tokens", "unlike"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """All rows of *docs* (doc_id, text and whatever else), with the lines of recurring templates taken out of text; adds n_lines and n_dropped.

    A null text stays null and an empty one empty; a text of which all lines go becomes empty; lines without a token stay. Repeated rows and copies
    come out alike. An empty table gives an empty one. Columns of *docs* named n_lines or n_dropped are replaced.
    """
    facts = durable(parsed_lines(docs).drop("mask"))
    templates = leaf_templates(docs, facts)
    parsed = facts.join(templates, "event", "left").withColumn("template", F.coalesce("template", "event")).select("template", "h", "size", "total", "position", "tokens")
    ends = [end(x).alias(f"{name}_{x}") for x in ("h", "size") for name, end in (("low", F.min), ("high", F.max))]
    several = parsed.groupBy("template").agg(*ends).filter("low_h != high_h or low_size != high_size").select("template")
    held = durable(parsed.join(several, "template"))
    gone = held.join(recurring(docs, held), "template").groupBy("h", "size").agg(F.collect_set("position").alias("gone"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = {x: f"{x}{'_' * max(map(len, kept))}" for x in ("h", "size", "gone", "lines")}  # longer than any column of docs
    keyed = docs.select(*kept).withColumns({own["h"]: F.xxhash64("text"), own["size"]: F.length("text")})
    gone = gone.select(*[F.col(x).alias(own[x]) for x in ("h", "size", "gone")])
    joined = keyed.join(gone, [own["h"], own["size"]], "left").withColumn(own["lines"], F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size(own["lines"]) - 1), F.col(own["gone"]))
    rest = F.array_join(F.transform(left, lambda i: F.get(own["lines"], i)), "\n")
    out = joined.withColumns({
        "text": F.when(F.col(own["gone"]).isNull(), F.col("text")).otherwise(rest),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(own["lines"])).cast("long"),
        "n_dropped": F.coalesce(F.size(own["gone"]), F.lit(0)).cast("long"),
    })
    return out.select(*kept, "n_lines", "n_dropped")
