"""Line de-duplication by a log-template tree.

A line is parsed as log lines are: tokens that hold a digit become ``<*>``, and the line falls down a tree of fixed depth
by its number of tokens and its ``LEADING`` first tokens; the rest is cut into ``RUNS`` runs of about equal length. Lines
that meet in a node and share one run are a group. In a group, the commonest token of each position makes the
template; a line with at least ``SIMILAR`` per cent of its tokens equal to it belongs to that template, the other tokens being its
variable fields. So a leaf has as many templates as its lines have common runs. Where several templates share a run,
the lines that agree in all runs but one have that one as variable field: such a template needs no vote. And a line is always
an instance of its own (masked) form. Lines of fewer than ``LEAST_TOKENS`` tokens have no variable fields: they recur as
equal masked lines, or, if nothing but ``<*>`` is left of them, as equal lines.

A line goes, from all documents, if one of its templates recurs: at least ``LEAST_DOCS`` holders have it. Copied documents
share all their lines, which says nothing about a line: documents with at least ``ALIKE`` per cent of their word pairs in common
(estimated from the least hashes of ``BINS`` bins: one-permutation MinHash) are copies, linked ones are a group, and a group
is one holder. So text that only copies share stays, for near-duplicate removal to deal with. Copies are looked for among all
documents that have a line of a recurring template. A document is sketched from all its lines if a fifth of its words or more are in such lines, as
in groups of three copies or more; and from its other lines if a third or less are, as in pairs of copies, so that a line
which many hold does not bring all its holders together. Between the two it has both sketches. They are dealt to ``BANDS`` buckets of three values and compared with two centres of each; the members of buckets that are more than one group then
are dealt anew by their rarest values, where all of different groups are compared.

Each line is parsed once, into a narrow table; only lines that share a run with ``LEAST_DOCS`` others go further. Sets of
keys are broadcast if they are small (``common.BROADCAST`` rows of a few numbers), and shuffled beyond that, where adaptive execution
splits hot keys. Counts are combined before every shuffle. Texts are shuffled once, at the
end, whatever the size of what they meet there.

Cases: null text stays null, empty text stays empty. Repeated rows of a doc_id are one holder and lose the same lines.
Null ids are never holders and stay whole. Lines are split at line feeds; blank lines stay. Extra columns are ignored,
but for those named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, sized
from .neardup import components

LEADING, RUNS, SIMILAR, LEAST_DOCS, LEAST_TOKENS = 2, 3, 70, 3, 5
ALIKE, BINS, GROUPS, BANDS = 65, 64, 16, 24
#: Per cent of words in recurring lines from which on all lines count, and up to which the others do.
WHOLE, OTHERS = 20, 33
#: Lost lines of a document that are looked through one by one.
MANY = 32
_WORD = r"[^\x20\x09-\x0D]"


def tokens_of(line: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), "")


def masked_tokens(line: Column) -> Column:
    """The same, with ``<*>`` for each word that holds a digit; most lines are split without a regular expression."""
    plain = F.translate(F.regexp_replace(line, rf"{_WORD}*[0-9]{_WORD}*", "<*>"), "\t\x0b\x0c\r", "    ")
    return F.array_remove(F.split(F.when(line.rlike(r"[0-9\x09-\x0D]"), plain).otherwise(line), " "), "")


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.hash(t))


def run(k: int) -> str:
    """The k-th run of ``ids`` as SQL."""
    begin, end = (f"(size(ids) - {LEADING}) * {i} div {RUNS}" for i in (k, k + 1))
    return f"slice(ids, cast({begin} + {LEADING + 1} as int), cast({end} - {begin} as int))"


def node(k: int, *runs: int) -> Column:
    """The key of a line's node and of some of its runs; k tells apart what the key is for."""
    return F.xxhash64(F.lit(k), F.size("ids"), *(F.expr(f"ids[{i}]") for i in range(LEADING)), *(F.expr(run(r)) for r in runs))


def parse(docs: DataFrame) -> DataFrame:
    """doc_id, line_key, ids (hashes of the masked tokens), exact, keys (of its groups) of each line that is not blank."""
    lines = docs.filter("doc_id is not null and text is not null").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    # blank lines are told by the line itself: a filter on the tokens would compute them twice
    lines = lines.filter(F.col("line").rlike(_WORD)).withColumn("ids", hashed(masked_tokens(F.col("line"))))
    bare = (F.size("ids") < LEAST_TOKENS) & (F.size(F.array_remove("ids", F.hash(F.lit("<*>")))) == 0)
    exact = F.when(bare, F.xxhash64(hashed(tokens_of(F.col("line"))))).otherwise(F.xxhash64("ids"))
    lines = lines.select("doc_id", F.xxhash64("line").alias("line_key"), "ids", exact.alias("exact"))
    return lines.withColumn("keys", F.when(F.size("ids") >= LEAST_TOKENS, F.array(*(node(k, k) for k in range(RUNS)))).otherwise(F.array("exact")))


def generalised(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(exact, template) of the forms (key, exact, ids, n), for templates of two forms or more."""
    tokens = forms.select("key", "n", F.posexplode("ids").alias("place", "token")).groupBy("key", "place", "token").agg(F.sum("n").alias("n"))
    top = tokens.groupBy("key", "place").agg(F.max(F.struct("n", "token")).alias("top"))
    model = top.groupBy("key").agg(F.expr("transform(sort_array(collect_list(struct(place, top.token))), x -> x.token)").alias("model"))
    equal = F.expr("size(filter(zip_with(ids, model, (t, m) -> t = m), x -> x))")
    voted = forms.join(model, "key").filter(100 * equal >= SIMILAR * F.size("ids")).select("exact", F.xxhash64(F.lit("voted"), "key").alias("template"))
    all_but = F.array(*(node(RUNS + k, *(r for r in range(RUNS) if r != k)) for k in range(RUNS)))
    plain = forms.groupBy("exact").agg(F.any_value("ids").alias("ids")).select("exact", F.explode(all_but).alias("template"))
    made = scratch.save(voted.unionByName(plain), "made")
    several = made.groupBy("template").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).filter("lo < hi").select("template")
    return scratch.save(made.join(sized(several), "template", "left_semi").select("exact", "template"), "general")


def instances(scratch: Scratch, lines: DataFrame) -> DataFrame:
    """doc_id, line_key, template: each line with those of its templates that LEAST_DOCS documents have."""
    groups = lines.select("exact", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"), (F.min("exact") < F.max("exact")).alias("mixed")).filter(f"n >= {LEAST_DOCS}").select("key", "mixed")
    groups = scratch.save(groups, "groups")
    met = lines.withColumn("key", F.explode("keys")).join(sized(groups), "key")
    met = scratch.save(met.select("doc_id", "line_key", "exact", "key", "mixed", F.when(F.col("mixed"), F.col("ids")).alias("ids")), "met")
    forms = scratch.save(met.filter("mixed").groupBy("key", "exact").agg(F.any_value("ids").alias("ids"), F.count("*").alias("n")), "forms")
    general = generalised(scratch, forms)
    once = met.select("doc_id", "line_key", "exact").distinct()
    every = scratch.save(once.withColumn("template", F.col("exact")).unionByName(once.join(sized(general), "exact").select(*once.columns, "template")).drop("exact"), "every")
    frequent = every.select("template", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("docs")).filter(f"docs >= {LEAST_DOCS}").select("template")
    frequent = scratch.save(frequent, "frequent")
    return scratch.save(every.join(sized(frequent), "template", "left_semi").select(*every.columns), "hits")


def bin_of(x: Column, bins: int) -> Column:
    """The bin of a hash: its leading bits; ``bins`` is a power of two."""
    return F.shiftrightunsigned(x, 65 - bins.bit_length())


def first_of_bins(values: str, bins: int) -> Column:
    """The first hash of each bin of sorted hashes."""
    at = F.col(values)
    return F.filter(at, lambda x, i: (i == 0) | (bin_of(x, bins) != bin_of(F.get(at, i - 1), bins)))


def sketched(lines: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, sketch of the documents with a line of a recurring template: the first hash of word pairs in each bin, of all lines or of the others."""
    held = lines.join(sized(hits.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "line_key", "ids", F.lit(False).alias("hit"))
    known = hits.select("doc_id", "line_key", F.lit(None).cast("array<int>").alias("ids"), F.lit(True).alias("hit"))
    # dealt by document, so that lines meet their hits and then each other without another exchange
    held = held.unionByName(known).repartition("doc_id").groupBy("doc_id", "line_key").agg(F.any_value("ids", True).alias("ids"), F.max("hit").alias("hit"))
    pair = F.expr("transform(sequence(0, greatest(size(ids) - 2, 0)), i -> xxhash64(ids[i], get(ids, i + 1)))")
    some = lambda hit: F.flatten(F.collect_list(F.when(F.col("hit") == hit, pair)))
    both = held.groupBy("doc_id").agg(some(True).alias("shared"), some(False).alias("own"))
    n, m = F.size("shared"), F.size("shared") + F.size("own")
    kinds = F.array(F.when(100 * n >= WHOLE * m, F.concat("shared", "own")), F.when(100 * n <= OTHERS * m, F.col("own")))
    each = both.select("doc_id", F.explode(F.array_compact(kinds)).alias("pairs")).filter(F.size("pairs") > 0)
    return each.select("doc_id", F.sort_array("pairs").alias("pairs")).select("doc_id", first_of_bins("pairs", BINS).alias("sketch"))


def copies(spark: SparkSession, scratch: Scratch, lines: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, holder: the copy group of each document with a hit that is linked to another one."""
    # equal sketches are one row, so a group of equal copies of any size is
    same = scratch.save(sketched(lines, hits).select("doc_id", F.xxhash64("sketch").alias("rep"), "sketch"), "sketches")
    full = F.aggregate("sketch", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bin_of(x, BINS).cast("int"))))
    # a bit for each bin that isn't empty
    kept = scratch.save(same.groupBy("rep").agg(F.any_value("sketch").alias("sketch")).withColumn("full", full), "kept")
    value = lambda b: F.try_element_at("at", F.lit(b % GROUPS).cast("long"))
    places = [(b, b + 5, b + 11) if b < GROUPS else (b, b + 3, b + 7) for b in range(BANDS)]
    band = [F.when(F.coalesce(*map(value, p)).isNotNull(), F.xxhash64(F.lit(i), *map(value, p))) for i, p in enumerate(places)]
    dealt = kept.select("rep", F.map_from_entries(F.transform(first_of_bins("sketch", GROUPS), lambda x: F.struct(bin_of(x, GROUPS), x))).alias("at"))
    sides = scratch.save(dealt.select("rep", F.explode(F.array_compact(F.array(*band))).alias("bucket")), "sides")
    scratch.drop("lines")
    # a document may have two sketches, which are one
    same = scratch.save(same.select("doc_id", "rep"), "named")
    scratch.drop("sketches")
    twice = same.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("a", "b")
    group = alike(spark, scratch, kept, sides, twice).withColumnRenamed("id", "rep")
    named = same.select("doc_id", "rep").join(group, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    names = named.groupBy("comp").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("hi")).filter("holder < hi").select("comp", "holder")
    return scratch.save(named.join(names, "comp").groupBy("doc_id").agg(F.min("holder").alias("holder")), "holders")


def without(lines: Column, gone: Column) -> Column:
    """The lines whose keys are not among ``gone``.

    Many keys are dealt to as many drawers as the root of their number, so that neither making the drawers nor looking into them takes lines x keys."""
    drawers = F.when(F.size(gone) > MANY, F.ceil(F.sqrt(F.size(gone))).cast("int")).otherwise(1)
    dealt = F.transform(F.sequence(F.lit(0), drawers - 1), lambda b: F.filter(gone, lambda g: F.pmod(g, drawers) == b))
    # as the argument of a lambda the drawers are made once, not for each line
    stays = lambda x, held: ~F.array_contains(F.get(held, F.pmod(F.xxhash64(x), F.size(held)).cast("int")), F.xxhash64(x))
    return F.get(F.transform(F.array(dealt), lambda held: F.filter(lines, lambda x: stays(x, held))), F.lit(0))


def rarest(left: DataFrame, kept: DataFrame) -> DataFrame:
    """rep, bucket: the sketches (rep) by those of their rarest values that another one holds too.

    Two sketches of ALIKE per cent have so many values in common that, in one order of all values, the first of them stands among the first
    n - ceil(n * ALIKE / 100) + 1 of both (n: the values of a sketch). In the order of frequency what many have in common comes last."""
    values = left.join(kept, "rep").select("rep", F.size("sketch").alias("n"), F.explode("sketch").alias("value"))
    known = values.groupBy("value").agg(F.count("*").alias("held")).filter("held > 1")
    ranked = values.join(known, "value").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("held", "value"))).alias("order"))
    # values that no other sketch holds come before all others
    first = F.expr(f"n - ceil(n * {ALIKE} / 100) + 1 - (n - size(`order`))").cast("int")
    return ranked.select("rep", F.explode(F.slice("order.value", F.lit(1), F.greatest(first, F.lit(0)))).alias("bucket"))


def alike(spark: SparkSession, scratch: Scratch, kept: DataFrame, sides: DataFrame, more_links: DataFrame) -> DataFrame:
    """id, comp: the linked groups of the sketches (rep, sketch, full) that share a bucket (rep, bucket), and of further links (a, b).

    A bucket's members are compared with its least and greatest id. Members of buckets that are not one group then are dealt anew, to a bucket for each of their ``rarest``
    values: all that are alike meet there, and those that share only what many have (a passage, a frequent line) do not. There all members of
    different groups are compared, so that no two alike ones of those dealt anew stay apart."""
    left, right = (kept.select(F.col("rep").alias(x), F.col("sketch").alias(f"s_{x}"), F.col("full").alias(f"f_{x}")) for x in "ab")
    close = f"100 * size(array_intersect(s_a, s_b)) >= {ALIKE} * bit_count(f_a | f_b)"

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        return scratch.save(pairs.distinct().join(left, "a").join(right, "b").filter(close).select(*pairs.columns), name)

    def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
        """rep, bucket, comp of the buckets that are not one group."""
        known = members.join(sized(labels.withColumnRenamed("id", "rep")), "rep", "left").select("rep", "bucket", F.coalesce("comp", "rep").alias("comp"))
        several = known.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("bucket")
        return known.join(several, "bucket")

    ends = sides.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    met = scratch.save(sides.join(ends, "bucket").select("rep", "bucket", "lo", "hi"), "met")
    scratch.drop("sides")
    # the two centres stand in each row
    stars = met.select("rep", F.explode(F.array("lo", "hi")).alias("end")).filter("rep <> end").select(F.greatest("rep", "end").alias("a"), F.least("rep", "end").alias("b"))
    labels = components(spark, more_links.unionByName(linked(stars, "links-0").select("a", "b")), scratch, "groups")
    unmet = scratch.save(apart(met, labels).select("rep").distinct(), "unmet")
    scratch.drop("met")
    members = scratch.save(apart(rarest(unmet, kept), labels), "members")
    one, other = (members.select(F.col("rep").alias(x), "bucket", F.col("comp").alias(f"comp_{x}")) for x in "ab")
    across = one.join(other, "bucket").filter("comp_a <> comp_b and a > b").drop("bucket")
    joined = components(spark, linked(across, "links-1").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), scratch, "joined")
    # groups that a late link joins, and what was alone until then
    every = labels.unionByName(joined.select("id", F.col("id").alias("comp"))).distinct()
    every = every.join(joined.select(F.col("id").alias("comp"), F.col("comp").alias("name")), "comp", "left").select("id", F.coalesce("name", "comp").alias("comp"))
    for name in ("unmet", "members", "links-0", "links-1"):
        scratch.drop(name)
    return every


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, text without recurring lines, n_lines, n_dropped (of the row's lines)."""
    scratch = Scratch(spark, "linededup")
    docs = docs.select("doc_id", "text", *keep)
    lines = scratch.save(parse(docs), "lines")
    hits = instances(scratch, lines)
    for name in ("groups", "met", "forms", "made", "general", "every", "frequent"):
        scratch.drop(name)
    holders = copies(spark, scratch, lines, hits)
    counted = hits.select("doc_id", "template").distinct().join(holders, "doc_id", "left").select("template", F.coalesce("holder", "doc_id").alias("holder")).distinct()
    recurring = scratch.save(counted.groupBy("template").agg(F.count("*").alias("holders")).filter(f"holders >= {LEAST_DOCS}").select("template"), "recurring")
    gone = scratch.save(hits.join(sized(recurring), "template", "left_semi").groupBy("doc_id").agg(F.collect_set("line_key").alias("gone")), "gone")
    for name in ("lines", "hits", "named", "kept", "holders", "recurring"):
        scratch.drop(name)
    joined = docs.join(gone.hint("merge"), "doc_id", "left").withColumn("lines", F.split("text", "\n"))
    joined = joined.withColumn("left", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(without(F.col("lines"), F.col("gone"))))
    return joined.select("doc_id", *keep, F.expr("if(gone is null, text, array_join(`left`, '\n'))").alias("text"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_dropped"))
