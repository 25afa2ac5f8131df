"""Personal data: candidates, boosted trees, calibrated thresholds. DataFrame functions only.

High-recall generators propose spans that may overlap: the base patterns, and looser
forms (bracketed and spelled-out mail addresses, grouped phone numbers, cards with other
separators or 15 digits, defanged and hexadecimal addresses). Base spans that pass their
check are always kept. For all other candidates, failed base matches among them, boosted
trees weigh the form, format and context; a candidate that reaches the calibrated
threshold of its form and touches no base span is added.

No documents are labelled, so the trees learn from PLANTED short texts made by rule
(:func:`planted`): personal data in loose forms, and what looks like it but isn't (order
numbers, dates, versions, failing check digits, octets over 255), after words that point to
it, away from it, or neither. Labels come from what was planted, never from the base
patterns. Half of the texts fit the trees, the other half calibrates each form's threshold
to PRECISION; a form that never reaches it adds nothing. Only counts of distinct
feature vectors (at most prod(LEVELS)) reach the driver; the corpus isn't looked at.

Patterns are possessive where that changes nothing, and begin only where a run
of their first characters begins, so that long runs cost linear time; running sums go
block by block, and overlaps by binary search, so that many matches in one text don't
cost their square.

Definitions: null text is empty. Positions are code points, ends exclusive.
Repeated rows are treated each; columns of any name pass through; no rows give none.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release

#: Texts made to learn from.
PLANTED = 6_000
ROUNDS = 24
RATE = 0.4
PRECISION = 0.95
LEAST_SUPPORT = 20
#: Entries of one block of a running sum.
BLOCK = 256

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "bracketed_mail": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]++)++"),
    "spelled_mail": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++"),
    "hex_ip": ("ip", r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}+(?:::?[0-9A-Fa-f]{1,4}+){2,7}+(?![0-9A-Za-z:])"),
    "defanged_ip": ("ip", r"(?<![0-9.])[0-9]++(?:(?:\[(?:\.|dot)\]|\((?:\.|dot)\))[0-9]++){3}+"),
    "other_card": ("card", r"(?<![0-9])(?:[0-9]{4}(?:[./_][0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])"),
    "grouped_phone": ("phone", r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ ./-])(?:[0-9]{2,4}[ ./-]){1,3}[0-9]{2,4}(?![0-9])"),
}
FORMS = {**{k: k for k in KINDS}, **{name: kind for name, (kind, _) in LOOSE.items()}}
#: Text that a match must hold (one of several), as a cheap guard before the pattern runs.
NEEDS = {"email": "@", "phone": "+", "bracketed_mail": "[at] (at) {at}", "spelled_mail": " dot ", "hex_ip": ":", "defanged_ip": "[.] (.) [dot] (dot)"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
OCTETS = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
CONTEXT = {
    "email": r"(?i)(mail|contact|write|address|reach)",
    "ip": r"(?i)(\bip|host|server|addr)",
    "card": r"(?i)(card|visa|credit|pay|amex)",
    "phone": r"(?i)(tel|phone|call|fax|mobil|dial)",
}
AGAINST = r"(?i)\b(?:order|invoice|version|release|part|isbn|serial|model|ticket|item|article|page|date|section|build|time)s?\b"
#: A year, month and day, either way round: no phone number.
DATE = r"^(?:(?:19|20)[0-9]{2}[ ./-](?:0?[1-9]|1[0-2])[ ./-](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[ ./-](?:0?[1-9]|[12][0-9]|3[01])[ ./-](?:19|20)[0-9]{2})$"
#: Values of the features: form, digits (in fours), separators, left and right edge, context for and against, check passed, brackets.
#: Forms that a word against them doesn't make less likely: nobody writes a part number that way.
CERTAIN = ("bracketed_mail", "defanged_ip")
LEVELS = (len(FORMS), 8, 4, 2, 2, 2, 2, 2, 2)

def _with_running(rows: DataFrame, step: Callable[[Column, Column], Column], **sums: str) -> DataFrame:
    """Add columns: of an array of ints (none below 0), what ``step`` makes of all entries before each.

    Columns in between keep lambdas from computing anything anew for each entry.
    """
    none = F.expr("cast(array() as array<int>)")
    one = lambda acc, v: F.struct(step(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    scan = lambda values, at: F.aggregate(values, F.struct(at.alias("at"), none.alias("out")), one, lambda acc: acc["out"])
    every = {new: F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")) for new, values in sums.items()}
    rows = rows.withColumns({f"{new}_blocks": F.when(F.size(values) > 0, F.transform(every[new], partial(_block, values))) for new, values in sums.items()})
    rows = rows.withColumns({f"{new}_tops": F.transform(f"{new}_blocks", lambda b: F.aggregate(b, F.lit(0), step)) for new in sums})
    made = {new: F.flatten(F.zip_with(f"{new}_blocks", scan(F.col(f"{new}_tops"), F.lit(0)), scan)) for new in sums}
    return rows.withColumns({new: F.coalesce(x, none) for new, x in made.items()}).drop(*[f"{new}_{x}" for new in sums for x in ("blocks", "tops")])


def _block(values: str, b: Column) -> Column:
    return F.slice(values, b * BLOCK + 1, BLOCK)


def _guarded(form: str, text: Column, made: Column, none: Column) -> Column:
    if form not in NEEDS:
        return made
    needs = NEEDS[form].split() if form in ("bracketed_mail", "defanged_ip") else [NEEDS[form]]
    return F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in needs]), made).otherwise(none)


def _with_spans(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Add all_<form>: array of (start, end, value) of the matches in text, which is split only where there is one."""
    text, empty = F.col("text"), F.expr("cast(array() as array<string>)")
    rows = rows.withColumns({f"found_{k}": _guarded(k, text, F.regexp_extract_all(text, F.lit(p), F.lit(0)), empty) for k, p in patterns.items()})
    none = F.expr("cast(array() as array<struct<gap:int,size:int,value:string>>)")
    rows = rows.withColumns({f"both_{k}": F.when(F.size(f"found_{k}") > 0, F.zip_with(F.split(text, p, -1), f"found_{k}", _match)).otherwise(none) for k, p in patterns.items()})
    rows = rows.withColumns({f"both_{k}": F.filter(f"both_{k}", lambda x: x["value"].isNotNull()) for k in patterns})
    rows = rows.withColumns({f"size_{k}": F.transform(f"both_{k}", lambda x: x["gap"] + x["size"]) for k in patterns})
    rows = _with_running(rows, lambda a, b: a + b, **{f"before_{k}": f"size_{k}" for k in patterns})
    place = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["value"].alias("value"))
    rows = rows.withColumns({f"all_{k}": F.zip_with(f"both_{k}", f"before_{k}", place) for k in patterns})
    return rows.drop(*[f"{x}_{k}" for x in ("found", "both", "size", "before") for k in patterns])


def _match(gap: Column, value: Column) -> Column:
    return F.struct(F.length(gap).alias("gap"), F.length(value).alias("size"), value.alias("value"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _digits(value: Column) -> Column:
    return F.translate(value, " ().+/_-", "")


def _luhn(digits: Column) -> Column:
    def total(d: Column) -> Column:
        digit = lambda i: F.ascii(F.substring(d, i, F.lit(1))) - 48
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + _let(digit(i) * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))

    return _let(F.reverse(digits), total) % 10 == 0


def _valid(form: str, value: Column) -> Column:
    """Whether a value passes the check of its form."""
    n = F.length(_digits(value))
    if form in ("ip", "defanged_ip"):
        return F.regexp_replace(value, r"[\[(](\.|dot)[\])]", ".").rlike(OCTETS)
    if form == "hex_ip":
        groups, gap = F.size(F.split(value, "::?")), F.size(F.split(value, "::"))
        return ((gap == 1) & (groups == 8)) | ((gap == 2) & (groups < 8))
    if form in ("card", "other_card"):
        return F.when(n.between(16 if form == "card" else 15, 19), _luhn(_digits(value))).otherwise(False)
    if form == "grouped_phone":
        return n.between(8, 15) & ~value.rlike(DATE)
    if form == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _passes(form: str, s: Column) -> Column:
    return _valid(form, s["value"])


def _of_kind(kind: str, c: Column) -> Column:
    return c["kind"] == kind


def _features(form: str, s: Column, text: Column) -> Column:
    before = F.when(s["start"] >= 24, F.substring(text, s["start"] - 23, F.lit(24))).otherwise(F.substring(text, F.lit(1), s["start"]))
    after = F.substring(text, s["end"] + 1, F.lit(1))
    return _let(F.struct(before.alias("before"), after.alias("after"), s["value"].alias("value")), partial(_weighed, form))


def _weighed(form: str, x: Column) -> Column:
    before, after, value = x["before"], x["after"], x["value"]
    marks = F.length(value) - F.length(F.translate(value, " ./_()-", ""))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return F.struct(
        F.lit(list(FORMS).index(form)).alias("f0"),
        F.least(F.floor(F.length(F.regexp_replace(value, "[^0-9]", "")) / 4).cast("int"), F.lit(7)).alias("f1"),
        F.least(marks, F.lit(3)).alias("f2"),
        flag((before == "") | before.rlike(r"[^\p{L}\p{N}]$")).alias("f3"),
        flag((after == "") | after.rlike(r"^[^\p{L}\p{N}]")).alias("f4"),
        flag(before.rlike(CONTEXT[FORMS[form]])).alias("f5"),
        flag(before.rlike(AGAINST)).alias("f6"),
        flag(_valid(form, value)).alias("f7"),
        flag(value.rlike(r"[\[({]")).alias("f8"),
    )


def candidates(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep``, text, base_<kind> (valid spans), more (other candidates with features) for rows with text (never null)."""
    patterns = BASE | {k: p for k, (_, p) in LOOSE.items()}
    out = _with_spans(texts.select(*keep, "text"), patterns)
    base = [F.filter(f"all_{k}", partial(_passes, k)).alias(f"base_{k}") for k in KINDS]
    out = out.select(*keep, "text", *[f"all_{k}" for k in patterns], *base)
    more = [F.transform(F.filter(f"all_{k}", lambda s: ~_touched(s)), partial(_candidate, k)) for k in patterns]
    return out.select(*keep, "text", *[f"base_{k}" for k in KINDS], F.concat(*more).alias("more"))


def _touched(s: Column) -> Column:
    """Whether a span shares a place with a valid base span of any kind; those of a kind are sorted and apart."""
    out = F.lit(False)
    for k in KINDS:
        spans = F.col(f"base_{k}")
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
        first = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), _halving(spans, s), lambda acc: acc["lo"])  # the first that ends after s begins
        out = out | F.when(F.size(spans) > 0, F.coalesce(F.get(spans, first)["start"] < s["end"], F.lit(False))).otherwise(False)
    return out


def _halving(spans: Column, s: Column) -> Callable[[Column, Column], Column]:
    """One round of the search for the first of ``spans`` that ends after ``s`` begins."""

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        upper, lower = F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")), F.struct(acc["lo"].alias("lo"), mid.alias("hi"))
        return F.when(acc["lo"] >= acc["hi"], acc).when(F.get(spans, mid)["end"] <= s["start"], upper).otherwise(lower)

    return step


def _candidate(form: str, s: Column) -> Column:
    return F.struct(F.lit(FORMS[form]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _features(form, s, F.col("text")).alias("f"))


def _span(kind: str, s: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


class Boosted:
    """Additive trees of depth two over small integer features, logistic loss, and a threshold a form.

    ``fitted`` and ``held`` are counts (features, positives, negatives): the trees come from one, the thresholds from the other.
    """

    def __init__(self, fitted: list[tuple[tuple[int, ...], int, int]], held: list[tuple[tuple[int, ...], int, int]]):
        self.trees: list[tuple] = []
        pos, neg = sum(p for _, p, _ in fitted), sum(n for _, _, n in fitted)
        self.start = math.log((pos + 1) / (neg + 1))
        score = {f: self.start for f, _, _ in fitted}
        tests = [(j, v) for j, top in enumerate(LEVELS) for v in range(top - 1)]
        for _ in range(ROUNDS if pos and neg else 0):
            grads = []
            for f, p, n in fitted:
                q = 1 / (1 + math.exp(-score[f]))
                grads.append((f, p * (1 - q) - n * q, (p + n) * q * (1 - q)))
            tree = self._grow(grads, tests, 2)
            self.trees.append(tree)
            for f in score:
                score[f] += self._leaf(tree, f)
        self.thresholds = {}
        for k, form in enumerate(FORMS):
            own = sorted(((self.score(f), p, n) for f, p, n in held if f[0] == k), reverse=True)
            p_sum = n_sum = 0
            for i, (s, p, n) in enumerate(own):
                p_sum, n_sum = p_sum + p, n_sum + n
                last = i + 1 == len(own) or own[i + 1][0] < s
                if last and p_sum + n_sum >= LEAST_SUPPORT and p_sum >= PRECISION * (p_sum + n_sum):
                    self.thresholds[form] = s - 1e-9

    def score(self, f: tuple[int, ...]) -> float:
        return self.start + sum(self._leaf(tree, f) for tree in self.trees)

    def _grow(self, grads: list, tests: list, depth: int):
        g, h = sum(x[1] for x in grads), sum(x[2] for x in grads)
        best = (g * g / (h + 1) + 1e-9, None)
        for j, v in tests if depth else ():
            gl = hl = 0.0
            for f, a, b in grads:
                if f[j] <= v:
                    gl, hl = gl + a, hl + b
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1)
            if gain > best[0]:
                best = (gain, (j, v))
        if best[1] is None:
            return max(-4.0, min(4.0, RATE * g / (h + 1)))
        j, v = best[1]
        return (j, v, self._grow([x for x in grads if x[0][j] <= v], tests, depth - 1), self._grow([x for x in grads if x[0][j] > v], tests, depth - 1))

    def _leaf(self, tree, f) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if f[tree[0]] <= tree[1] else tree[3]
        return tree

    def _tree_column(self, tree, f: Column) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        j, v, low, high = tree
        return F.when(f[f"f{j}"] <= v, self._tree_column(low, f)).otherwise(self._tree_column(high, f))

    def accepts(self, c: Column) -> Column:
        """Whether a candidate reaches the threshold of its form."""
        if not self.thresholds:
            return F.lit(False)
        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + self._tree_column(tree, c["f"])
        least = F.lit(math.inf)
        for form, at in self.thresholds.items():
            least = F.when(c["f"]["f0"] == list(FORMS).index(form), F.lit(at)).otherwise(least)
        return (total >= least) & (c["f"]["f7"] == 1)  # what fails the check of its form is never added


def planted(spark: SparkSession, n: int = PLANTED) -> DataFrame:
    """id, text, start, end, kind (null: nothing personal) of ``n`` short texts made by rule from their number."""
    draw = lambda salt, top: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(top)).cast("int")
    pick = lambda salt, *xs: F.element_at(F.array(*map(F.lit, xs)), draw(salt, len(xs)) + 1)
    rows = spark.range(n).withColumn("random", F.translate(F.md5(F.concat(F.lit("planted"), F.col("id").cast("string"))), "abcdef", "172839"))
    rows = rows.withColumns({"hex": F.md5(F.col("id").cast("string")), "letters": F.translate(F.md5(F.concat(F.lit("word"), F.col("id").cast("string"))), "0123456789", "ghijklmnop")})
    digits = lambda at, size: F.substring("random", at, size)
    word = lambda k: F.substring("letters", 6 * k + 1, 6)
    hexes = lambda k, size: F.substring("hex", 4 * k + 1, size)
    sep, dot = pick("sep", ".", "/", "_"), pick("dot", "[.]", "(.)", "[dot]", "(dot)")
    amex = F.concat(F.lit("37"), digits(1, 2), F.lit(" "), digits(3, 6), F.lit(" "), digits(9, 4))
    other = F.concat_ws("", digits(1, 4), sep, digits(5, 4), sep, digits(9, 4), sep, digits(13, 3))
    rows = rows.withColumns({"other": F.when(draw("amex", 2) == 1, amex).otherwise(other), "card": digits(1, 15)})
    check = lambda c: F.filter(F.sequence(F.lit(0), F.lit(9)), lambda x: _luhn(_digits(F.concat(F.col(c), x.cast("string")))))[0]
    rows = rows.withColumns({"other_check": check("other"), "card_check": check("card")})
    wrong = lambda c: ((F.col(c) + 1 + draw("off", 9)) % 10).cast("string")
    octets = lambda d, top, low: F.concat_ws("", draw("o0", top) + low, d, draw("o1", 256), d, draw("o2", 256), d, draw("o3", 256))
    a, b, c, d = digits(1, 3), digits(4, 3), digits(7, 4), digits(11, 2)
    shapes = [F.concat_ws("", F.lit("("), a, F.lit(") "), b, F.lit("-"), c), F.concat_ws("-", a, b, c), F.concat_ws(".", a, b, c), F.concat_ws(" ", F.concat(F.lit("0"), d), c, digits(13, 4)), F.concat_ws(" ", F.concat(F.lit("00"), d), a, b, c)]
    date = F.concat_ws("-", F.concat(F.lit("20"), d), F.lpad((draw("m", 12) + 1).cast("string"), 2, "0"), F.lpad((draw("d", 28) + 1).cast("string"), 2, "0"))
    mail = F.concat(word(0), pick("at", " [at] ", "[at]", " (at) ", "(at)", " {at} "), word(1), pick("do", ".", " [dot] ", "(dot)"), pick("tld", "com", "org", "net", "example"))
    spelled = F.concat(word(0), F.lit(" at "), word(1), F.lit(" dot "), pick("tld", "com", "org", "net", "example"))
    halved = draw("halved", 2) == 1
    rows = rows.withColumns({"phone": F.array(*shapes)[draw("shape", len(shapes))], "good": draw("good", 2) == 1})

    # For each form what is planted: personal data, and its look-alike.
    made = {
        "bracketed_mail": (mail, F.concat(word(0), pick("at", " [at] ", " (at) "), word(1))),
        "spelled_mail": (spelled, F.concat(pick("verb", "look", "meet", "stop"), F.lit(" at "), word(1), F.lit(" dot "), word(2))),
        "hex_ip": (F.when(halved, F.concat(hexes(0, 4), F.lit(":"), hexes(1, 4), F.lit("::"), hexes(2, 4))).otherwise(F.concat_ws(":", *[hexes(k, 4) for k in range(8)])), F.when(halved, F.concat_ws(":", a, d, digits(13, 2), digits(15, 2))).otherwise(F.concat_ws(":", *[hexes(k, 2) for k in range(6)]))),
        "defanged_ip": (octets(dot, 256, 0), octets(dot, 700, 256)),
        "other_card": (F.concat("other", F.col("other_check").cast("string")), F.concat("other", wrong("other_check"))),
        "grouped_phone": (F.col("phone"), F.when(halved, date).otherwise(F.col("phone"))),
        "ip": (octets(F.lit("."), 256, 0), octets(F.lit("."), 700, 256)),
        "card": (F.concat("card", F.col("card_check").cast("string")), F.concat("card", wrong("card_check"))),
        "phone": (F.concat_ws(" ", F.concat(F.lit("+"), d), c, digits(13, 4)), F.concat_ws(" ", F.concat(F.lit("+"), d), b)),
    }
    words = {"email": ("mail me: ", "contact ", "please write to "), "ip": ("host ", "the server is ", "IP: "), "card": ("card ", "pay with ", "credit: "), "phone": ("call ", "phone: ", "tel. ", "fax ")}
    neutral, against = ("and then ", "we saw ", "", "also the "), ("order no. ", "invoice ", "version ", "part ", "on the date ", "item ", "at the time ")
    plants = []
    for form, (yes, no) in made.items():
        # Failing checks also follow words that point to them; what looks the same is told by those words alone,
        # and brackets around an "at" or a dot are rare enough to tell unless a word speaks against them.
        pointed = draw("mood", 10) < F.when(F.col("good"), 8).otherwise(0 if form.endswith("_mail") or form == "grouped_phone" else 3)
        lead = F.when(pointed, pick("near", *words[FORMS[form]])).when((F.col("good") if form not in CERTAIN else F.col("good") & (draw("mood", 10) < 9)) | (draw("mood", 10) > (9 if form == "bracketed_mail" else 7)), pick("neutral", *neutral)).otherwise(pick("against", *against))
        plants.append(F.struct(F.lit(FORMS[form]).alias("kind"), F.when(F.col("good"), yes).otherwise(no).alias("value"), lead.alias("lead")))
    rows = rows.withColumn("plant", F.array(*plants)[draw("form", len(plants))])
    rows = rows.select("id", F.concat(word(3), F.lit(" "), word(4), F.lit(" "), F.col("plant.lead")).alias("before"), F.col("plant.value").alias("value"), F.when(F.col("good"), F.col("plant.kind")).alias("kind"))
    text = F.concat("before", "value", pick("stop", "", ".", ", and so on", " today"))
    return rows.select("id", text.alias("text"), F.length("before").alias("start"), (F.length("before") + F.length("value")).alias("end"), "kind")


def counted(examples: DataFrame) -> DataFrame:
    """half (0: fits, 1: calibrates), f, p, n: positives and candidates of every feature vector among planted texts."""
    found = candidates(examples, "id", "start", "end", "kind").select("id", "start", "end", "kind", F.explode_outer("more").alias("c")).where("c IS NOT NULL")  # outer: no filter is inferred that would build everything anew
    hit = F.coalesce(F.col("kind") == F.col("c.kind"), F.lit(False)) & (F.col("c.start") < F.col("end")) & (F.col("start") < F.col("c.end"))
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2))
    return found.groupBy(half.alias("half"), F.col("c.f").alias("f")).agg(F.sum(hit.cast("long")).alias("p"), F.count("*").alias("n"))


def fit(spark: SparkSession) -> Boosted:
    """Trees from one half of the planted texts, thresholds from the other."""
    examples = materialise(planted(spark), "planted")
    rows = sorted((r["half"], tuple(r["f"]), r["p"], r["n"] - r["p"]) for r in counted(examples).collect())  # at most 2 * prod(LEVELS) rows
    release(examples)
    return Boosted([r[1:] for r in rows if r[0] == 0], [r[1:] for r in rows if r[0] == 1])


def find(texts: DataFrame, model: Boosted, *keep: str) -> DataFrame:
    """``keep``, text, base_<kind> and spans: array of (kind, start, end), by kind as listed, then start."""
    found = candidates(texts, *keep).withColumn("extra", F.filter("more", model.accepts))
    per_kind = []
    for kind in KINDS:
        own = F.transform(F.filter("extra", partial(_of_kind, kind)), partial(_span, kind))
        per_kind.append(F.array_distinct(F.array_sort(F.concat(F.transform(f"base_{kind}", partial(_span, kind)), own))))
    return found.withColumn("spans", F.concat(*per_kind)).drop("more", "extra")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, model: Boosted) -> DataFrame:
    """doc_id, counts of base spans a kind, their SHA-256, and all spans as text."""
    found = find(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model, "doc_id")
    base = F.concat(*[F.transform(f"base_{k}", partial(_span, k)) for k in KINDS])
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: Boosted) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null texts stay null; n_chars, where it is a column, follows the new text.
    """
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = find(rows, model, "row").select("row", "text", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))
    found = _with_running(found.withColumn("ends", F.transform("spans", lambda s: s["end"])), lambda a, b: F.greatest(a, b), before="ends")
    text, at = F.col("text"), F.lit(1)
    piece = lambda s, end: F.when(s["start"] < end, F.lit("")).otherwise(F.concat(F.substring(text, end + at, s["start"] - end), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.substring(text, F.array_max(F.transform("spans", lambda s: s["end"])) + at, F.length(text))
    whole = F.concat(F.array_join(F.zip_with("spans", "before", piece), ""), tail)
    new = F.when(F.size("spans") > 0, whole).otherwise(F.col("row")["text"])
    out = found.select("row", new.alias("new"))

    def column(c: str) -> Column:
        old = F.col("row").getField(c)
        if c == "text":
            return F.col("new").alias(c)
        if c == "n_chars":
            kind = docs.schema[c].dataType
            return F.when(F.col("new").eqNullSafe(F.col("row")["text"]), old).otherwise(F.coalesce(F.length("new").cast(kind), old)).alias(c)
        return old.alias(c)

    return out.select(*map(column, docs.columns))
