"""Personal data by candidate gradient boosting, with DataFrame functions only.

Base spans follow fixed patterns with a check each (ip: parts up to 255; card: 14 to 19 digits
that pass Luhn; phone: 10 to 15 digits) and always stay. High-recall generators propose further
spans, which may overlap each other and base spans: spelt-out and spaced addresses, numbers without
a country code, long runs of digits, IPv6 addresses in full and short, dotted card groups. Boosted
trees over format and context features score each proposal; a threshold for each kind, calibrated
on examples with other cue words than those of training, selects. What base spans cover is dropped;
selected spans that overlap are one span, of the kind that scores best. The trees are trained on
the driver, once a process, on a bounded set of examples built from a rule (see examples), whose
features the same column expressions compute; they are then a literal array that columns evaluate.

Patterns are written so that neither long runs nor many repeats make them backtrack or recurse.
A match's place is the sum of the lengths of the gaps and matches before it, in code points; sums
and other running values over a row's matches take log2(n) passes, and pieces of text are cut from
chunks, so a very long text full of matches takes time nearly in proportion to its length.

Null and empty texts have no spans. Rows that repeat are treated alike, an empty table gives an
empty one, and all columns of the input stay what they are, whatever their names: helper columns
get a prefix that no column has. Everything is done row by row, without a shuffle."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_L = "A-Za-z0-9._%+-"
_D = "A-Za-z0-9-"
#: The base patterns. \G is the end of the match before: a run may also be entered there.
BASE = {
    "email": rf"(?:\G|(?<![{_L}]))[{_L}]++@[{_D}]++\.[{_D}](?:[{_D}.](?<!\.(?![{_D}])))*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9 -](?<![ -](?![0-9])))++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Texts without this have no match of the kind.
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_AT = r"(?: ?[(\[{]at[)\]}] ?| at )"
_DOT = r"(?: ?[(\[{]dot[)\]}] ?| dot |\.)"
_END = r"(?![0-9]|[.-][0-9])"
#: Generators: kind, pattern, and what a text must have (a pattern, or a string to contain).
WIDE = {
    "spelt": ("email", rf"(?<![{_L}])[{_L}]{{1,64}}{_AT}[{_D}]{{1,63}}{_DOT}[{_D}]{{1,63}}(?:{_DOT}[{_D}]{{1,63}})?(?![{_D}])", r"(?:at[)\]}]| at )"),
    "spaced": ("email", rf"(?<![{_L}])[{_L}]{{1,64}} ?@ ?[{_D}]{{1,63}}(?: ?\. ?[{_D}]{{1,63}}){{1,3}}(?![{_D}])", r" @|@ "),
    "ipv6": ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "short_ipv6": ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])", "::"),
    "dotted": ("card", rf"(?<![0-9.])[0-9]{{4}}(?:\.[0-9]{{4}}){{3}}{_END}", r"[0-9]{4}\.[0-9]{4}"),
    "grouped": ("phone", rf"(?<![0-9+.(-])(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})[ .-][0-9]{{3,4}}[ .-][0-9]{{3,4}}{_END}", r"[0-9][ .)-]"),
    "run": ("phone", rf"(?<![0-9A-Za-z+.(-])\(?[0-9](?:[ ().-]?[0-9]){{8,14}}{_END}", r"[0-9](?:[ ().-]?[0-9]){8}"),
}


# ---- arrays -----------------------------------------------------------------------------------

def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over each element and all before it, in log2(n) passes."""
    def steps(v):
        last = F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)))).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.call_function("shiftleft", F.lit(1), k))

    def one(acc, step):
        return F.transform(acc, lambda x, i: F.when(i >= step, op(F.get(acc, i - step), x)).otherwise(x))

    return _let(values, lambda v: F.aggregate(steps(v), v, one))


def _add(a: Column, b: Column) -> Column:
    return a + b


CHUNK = 1024


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, a: Column, b: Column) -> Column:
    """Code points a to b - 1 of the text in chunks."""
    i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
    start, end = F.coalesce(F.get(chunks, i), F.lit("")), F.coalesce(F.get(chunks, j), F.lit(""))
    longer = F.concat(F.substring(start, a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(end, F.lit(1), b % CHUNK))
    return F.when(i == j, F.substring(start, a % CHUNK + 1, b - a)).otherwise(longer)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.try_cast("int")).otherwise(x.try_cast("int") * 2))
    total = F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(F.coalesce(v, F.lit(0))))
    return total % 10 == 0


def _ok(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _found(text: Column, pattern: str, hint: Column) -> Column:
    """All matches of pattern with their places: array of (start, stop, m)."""
    def placed(pairs):
        stops = _running(F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["hit"])), _add)
        return F.zip_with(pairs, stops, lambda x, b: F.struct((b - F.length(x["hit"])).alias("start"), b.alias("stop"), x["hit"].alias("m")))

    def pairs(hits):
        both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
        return F.transform(F.slice(both, F.lit(1), F.size(hits)), lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit")))

    none = F.array().cast("array<struct<start:int,stop:int,m:string>>")
    got = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, _let(pairs(hits), placed)).otherwise(none))
    return F.when(hint, got).otherwise(none)


# ---- features, examples, trees ----------------------------------------------------------------

# Words that lead up to personal data, and words that lead up to other numbers. Training examples
# use the first half of each list and calibration the second.
_LEADS = {"email": "mail contact write reach", "phone": "call tel mobile cell phone fax dial text", "card": "card visa credit amex", "ip": "host ping server node"}
_OTHER = {"email": "look meet stare gather", "phone": "order part serial pages score invoice item ref", "card": "serial invoice isbn batch", "ip": "version ratio build release"}
_TAIL = r"[^A-Za-z0-9]{0,3}(?:[a-z]{1,4} ){0,2}$"


def _any(words: dict[str, str]) -> str:
    return rf"(?i)(?<![A-Za-z])(?:{'|'.join(sorted({w for some in words.values() for w in some.split()}))}){_TAIL}"


FEATURES = (*(f"is_{g}" for g in WIDE), "leads", "other", "brackets", "parenthesis", "digits", "length", "luhn", "hyphens", "dots", "spaces")


def candidate_features(generator: Column, m: Column, before: Column) -> list[Column]:
    """The columns of FEATURES for a match m that follows the text before."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    many = lambda ch: F.length(F.regexp_replace(m, f"[^{ch}]", "")).cast("double")
    out = [flag(generator == g) for g in WIDE]
    out += [flag(before.rlike(_any(_LEADS))), flag(before.rlike(_any(_OTHER))), flag(m.rlike(r"[\[{(](?:at|dot)")), flag(m.startswith("("))]
    out += [many("0-9"), F.length(m).cast("double"), flag(luhn(_digits(m)) & (F.length(_digits(m)) > 0))]
    return [*out, many("-"), many("."), many(" ")]


def examples(n: int = 1200, seed: int = 7, second: bool = False) -> list[tuple[str, str, str, int]]:
    """(generator, match, text before it, whether it is personal data): n examples, from a rule.

    second chooses the other half of the cue words. Three in a hundred have a cue of the other class."""
    rnd, rows = random.Random(seed), []
    letters = lambda lo, hi: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(lo, hi)))
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    hexa = lambda k: ":".join(f"{rnd.randrange(1, 65536):x}" for _ in range(k))

    def half(words):
        words = words.split()
        return words[len(words) // 2 :] if second else words[: len(words) // 2]

    for i in range(n):
        generator, yes = rnd.choice(list(WIDE)), i % 2
        kind = WIDE[generator][0]
        cue = rnd.choice(half((_LEADS if yes != (rnd.random() < 0.03) else _OTHER)[kind])) if rnd.random() < 0.8 or (yes and kind in ("phone", "card")) else letters(3, 8)
        before = f"{letters(3, 8)} {cue}{rnd.choice((' ', ': '))}"
        if generator == "spelt":
            a, d = rnd.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "))) if yes else (" at ", rnd.choice((" dot ", ".")))
            m = f"{letters(3, 8)}{a}{letters(3, 8)}{d}{rnd.choice(('com', 'org', 'net', 'de')) if yes else letters(3, 8)}"
        elif generator == "spaced":
            m = f"{letters(3, 8)} @ {letters(3, 8)}.{rnd.choice(('com', 'org', 'net'))}" if yes else f"{num(2)} @ {num(1)}.{num(2)}"
        elif generator == "ipv6":
            m = hexa(8)
        elif generator == "short_ipv6":
            m = f"{hexa(rnd.randint(1, 4))}::{hexa(rnd.randint(1, 3))}" if yes else f"{letters(1, 1)}::{num(1)}"
        elif generator == "dotted":
            d = num(15)
            check = -sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(d)) % 10
            d += str(check if yes else (check + rnd.randint(1, 9)) % 10)
            m = ".".join(d[j : j + 4] for j in range(0, 16, 4))
        elif generator == "grouped":
            s = rnd.choice(" .-")
            m = (f"({num(3)})" if yes and rnd.random() < 0.4 else num(3)) + s + num(3) + s + num(4)
        else:
            m = num(rnd.randint(9, 12)) if yes else rnd.choice((f"{num(4)}-{num(2)}-{num(2)} {num(2)}", num(13), f"{num(5)} {num(5)}", f"{num(3)}.{num(6)}"))
        rows.append((generator, m, before, yes))
    return rows


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.4) -> list[tuple]:
    """Gradient boosted trees of depth two for the logistic loss: (feature, cut, low, high), where
    low and high are leaves or (feature, cut, leaf, leaf)."""
    trees, s = [], np.zeros(len(y))

    def split(rows, g, h, depth):
        if depth:
            best = (1e-6, None)
            for j in range(x.shape[1]):
                for cut in np.unique(x[rows, j])[1:]:
                    low = rows & (x[:, j] < cut)
                    high = rows & ~low
                    gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    if gain > best[0]:
                        best = (gain, (j, float(cut), low, high))
            if best[1]:
                j, cut, low, high = best[1]
                return j, cut, split(low, g, h, depth - 1), split(high, g, h, depth - 1)
        return float(rate * g[rows].sum() / (h[rows].sum() + 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-s))
        tree = split(np.ones(len(y), bool), y - p, p * (1 - p), 2)
        trees.append(tree)
        s += np.array([evaluate(tree, r) for r in x])
    return trees


def evaluate(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def _trees(trees: list) -> Column:
    """The trees as a literal array: (feature, cut) of the root and of its two children, four leaves."""
    def child(t):
        return t if isinstance(t, tuple) else (0, 0.0, t, t)

    rows = []
    for t in trees:
        j, cut, low, high = child(t)
        low, high = child(low), child(high)
        numbers = (f"{x!r}D" for x in (cut, low[1], high[1], *low[2:], *high[2:]))
        names = ("cut", "low_cut", "high_cut", "a", "b", "c", "d")
        rows.append(f"named_struct('j', {j}, 'low', {low[0]}, 'high', {high[0]}, " + ", ".join(f"'{n}', {v}" for n, v in zip(names, numbers, strict=True)) + ")")
    return F.expr(f"array({', '.join(rows)})")


def _score(features: Column, trees: list) -> Column:
    def leaf(t, f):
        low = F.when(F.get(f, t["low"]) < t["low_cut"], t["a"]).otherwise(t["b"])
        high = F.when(F.get(f, t["high"]) < t["high_cut"], t["c"]).otherwise(t["d"])
        return F.when(F.get(f, t["j"]) < t["cut"], low).otherwise(high)

    return _let(features, lambda f: F.aggregate(_trees(trees), F.lit(0.0), lambda total, t: total + leaf(t, f)))


_TRAINED: dict[float, tuple[list, dict[str, float]]] = {}


def train(spark: SparkSession, precision: float = 0.95) -> tuple[list, dict[str, float]]:
    """Trees, and for each kind the lowest score whose precision is at least precision over the
    calibration examples. One Spark job, once a process."""
    if precision not in _TRAINED:
        rows = [(0, i, *r) for i, r in enumerate(examples())] + [(1, i, *r) for i, r in enumerate(examples(seed=8, second=True))]
        table = spark.createDataFrame(rows, "held int, i int, generator string, m string, before string, y int")
        features = candidate_features(F.col("generator"), F.col("m"), F.col("before"))
        got = table.select("held", "i", "generator", "y", F.array(*features).alias("f")).orderBy("held", "i").collect()
        x, y = np.array([r.f for r in got], float), np.array([r.y for r in got])
        held, kind = np.array([r.held for r in got], bool), np.array([WIDE[r.generator][0] for r in got])
        trees = boost(x[~held], y[~held])
        s = np.array([sum(evaluate(t, r) for t in trees) for r in x])
        least = {}
        for k in KINDS:
            some = held & (kind == k)
            cuts = [c for c in np.unique(s[some]) if c > 0 and y[some][s[some] >= c].mean() >= precision]
            least[k] = float(cuts[0]) if cuts else float("inf")
        _TRAINED[precision] = trees, least
    return _TRAINED[precision]


# ---- spans ------------------------------------------------------------------------------------

def _checked(kind: str, found: Column) -> Column:
    rank = F.lit(KINDS.index(kind))
    good = F.filter(found, lambda x: _ok(kind, x["m"]))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), rank.alias("rank"), x["stop"].alias("stop")))


_SPAN = "array<struct<start:int,rank:int,stop:int>>"


def _span(start: Column, rank: Column, stop: Column) -> Column:
    return F.struct(start.alias("start"), rank.alias("rank"), stop.alias("stop"))


def _proposed(number: int, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["m"].alias("m"), F.lit(number).alias("number")))


def _selected(proposals: Column, chunks: Column, trees: list, least: dict[str, float]) -> Column:
    """(start, rank, stop, score) of the proposals whose score reaches their kind's threshold, in order."""
    name = F.array(*map(F.lit, WIDE))
    rank = F.array(*(F.lit(KINDS.index(kind)) for kind, _, _ in WIDE.values()))
    bound = F.array(*(F.lit(least[kind]) for kind in KINDS))

    def scored(x):
        before = _cut(chunks, F.greatest(x["start"] - 24, F.lit(0)), x["start"])
        features = _let(before, lambda b: F.array(*candidate_features(F.get(name, x["number"]), x["m"], b)))
        return F.struct(x["start"].alias("start"), F.get(rank, x["number"]).alias("rank"), x["stop"].alias("stop"), _score(features, trees).alias("score"))

    return F.array_sort(F.filter(F.transform(proposals, scored), lambda x: x["score"] >= F.get(bound, x["rank"])))


def _not_covered(added: Column, base: Column) -> Column:
    """Those of added that no single base span covers."""
    def mark(spans, mine):
        score = (lambda x: x["score"]) if mine else (lambda x: F.lit(0.0))
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(mine).alias("mine"), x["stop"].alias("stop"), x["rank"].alias("rank"), score(x).alias("score")))

    def open_(both):
        reach = _running(F.transform(both, lambda x: F.when(x["mine"], 0).otherwise(x["stop"])), F.greatest)
        held = F.zip_with(both, reach, lambda x, r: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["stop"].alias("stop"), x["score"].alias("score"), (x["mine"] & (x["stop"] > r)).alias("ok")))
        return F.transform(F.filter(held, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["stop"].alias("stop"), x["score"].alias("score")))

    return _let(F.array_sort(F.concat(mark(base, False), mark(added, True))), open_)


def _merged(spans: Column) -> Column:
    """Spans (start, rank, stop, score) in order of start, where those that overlap are one: from the
    first's start to the last stop, with the rank of the best score (ties: the earlier, the kind)."""
    def numbered(t):
        new = F.transform(t, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(t, i - 1)["reach"]), 1).otherwise(0))
        return F.zip_with(t, _running(new, _add), lambda x, n: F.struct(n.alias("n"), x["score"].alias("score"), (-x["start"]).alias("early"), (-x["rank"]).alias("kind"), x["reach"].alias("reach")))

    def joined(v):
        best = _running(F.transform(v, lambda x: F.struct(x["n"].alias("n"), x["score"].alias("score"), x["early"].alias("early"), x["kind"].alias("kind"))), F.greatest)
        first = F.filter(v, lambda x, i: (i == 0) | (F.get(v, i - 1)["n"] != x["n"]))
        ends = F.zip_with(best, v, lambda b, x: F.struct(b["n"].alias("n"), b["kind"].alias("kind"), x["reach"].alias("reach")))
        last = _let(ends, lambda e: F.filter(e, lambda x, i: F.coalesce(F.get(e, i + 1)["n"] != x["n"], F.lit(True))))
        return F.zip_with(first, last, lambda a, b: _span(-a["early"], -b["kind"], b["reach"]))

    def reached(s):
        reach = _running(F.transform(s, lambda x: x["stop"]), F.greatest)
        return F.zip_with(s, reach, lambda x, r: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["score"].alias("score"), r.alias("reach")))

    return F.when(F.size(spans) > 0, _let(_let(_let(spans, reached), numbered), joined)).otherwise(F.array().cast(_SPAN))


def _prefix(columns: list[str]) -> str:
    """A beginning that no column's name has."""
    p = "_"
    while any(c.lower().startswith(p) for c in columns):
        p += "_"
    return p


def _with_spans(df: DataFrame, model, text_col: str) -> tuple[DataFrame, str]:
    """df with columns text, base and spans, each named with the prefix that is given back."""
    trees, least = train(df.sparkSession) if model is None else model
    p = _prefix(df.columns)
    own = [F.col(f"`{c}`") for c in df.columns]
    text, some, chunks, base = F.col(f"{p}text"), F.col(f"{p}digit"), F.col(f"{p}chunks"), F.col(f"{p}base")
    df = df.withColumn(f"{p}text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    df = df.withColumn(f"{p}digit", text.rlike("[0-9]"))
    found = {}
    for kind in KINDS:
        hint = F.lit(True) if _HINT[kind] is None else F.contains(text, F.lit(_HINT[kind]))
        found[f"{p}{kind}"] = _checked(kind, _found(text, BASE[kind], hint if kind == "email" else hint & some))
    for i, (g, (kind, pattern, hint)) in enumerate(WIDE.items()):
        hint = F.contains(text, F.lit(hint)) if hint == "::" else text.rlike(hint)
        found[f"{p}{g}"] = _proposed(i, _found(text, pattern, hint if kind in ("email", "ip") else hint & some))
    df = df.withColumns(found)
    df = df.withColumns({f"{p}base": F.array_sort(F.concat(*(F.col(f"{p}{k}") for k in KINDS))), f"{p}wide": F.concat(*(F.col(f"{p}{g}") for g in WIDE))})
    df = df.withColumn(f"{p}chunks", F.when(F.size(f"{p}wide") > 0, _chunks(text)))
    df = df.withColumn(f"{p}added", F.when(F.size(f"{p}wide") > 0, _selected(F.col(f"{p}wide"), chunks, trees, least)))
    plain = _merged(_not_covered(F.col(f"{p}added"), base))
    df = df.withColumn(f"{p}spans", F.when(F.size(f"{p}added") > 0, F.array_sort(F.concat(base, plain))).otherwise(base))
    return df.select(*own, f"{p}text", f"{p}base", f"{p}spans"), p


def find_pii(df: DataFrame, model=None, text_col: str = "text", base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """df's columns with base_col and spans_col, which must be new: arrays of (start, rank, stop) in
    order; rank is the kind's place in KINDS. spans_col holds the base spans and those selected."""
    if clash := {base_col.lower(), spans_col.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {sorted(clash)[0]} already; name the new ones otherwise")
    got, p = _with_spans(df, model, text_col)
    return got.select(*(F.col(f"`{c}`") for c in df.columns), F.col(f"{p}base").alias(base_col), F.col(f"{p}spans").alias(spans_col))


def _joined(spans: Column) -> Column:
    name = lambda r: F.element_at(F.array(*map(F.lit, KINDS)), r + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["rank"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def pii_digest(df: DataFrame, model=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = find_pii(rows, model)
    count = lambda k: F.size(F.filter("base", lambda x: x["rank"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(df: DataFrame, model=None, text_col: str = "text") -> DataFrame:
    """df with each span of text_col replaced by its kind in brackets; where spans overlap, the
    first one's kind stands for all of them."""
    found, p = _with_spans(df, model, text_col)
    text, spans = F.col(f"{p}text"), F.col(f"{p}spans")
    # the first of overlapping spans has the best score
    ranked = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["stop"].alias("stop"), F.lit(0.0).alias("score")))

    def out(chunks):
        def pieces(s):
            name = lambda x: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1)), F.lit("]"))
            each = F.transform(s, lambda x, i: F.concat(_cut(chunks, F.when(i == 0, 0).otherwise(F.get(s, i - 1)["stop"]), x["start"]), name(x)))
            return F.concat(F.array_join(each, ""), _cut(chunks, F.get(s, F.size(s) - 1)["stop"], F.length(text)))

        return _let(_merged(ranked), pieces)

    done = F.when(F.size(spans) > 0, _let(_chunks(text), out)).otherwise(F.col(f"`{text_col}`"))
    return found.select(*(done.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns))
