"""PII by candidate gradient boosting, with DataFrame functions only.

High-recall generators propose spans, which may overlap: the four base kinds, valid or not, and looser ones (secrets, numbers in the form of
identities, telephone numbers without a plus sign).  Each candidate gets binary features of its format and its context, packed into one
integer, and a weak label: whether it passes the check of its kind (checksums, ranges, numbers of digits, the mixture of letters and
digits).  What the checks look at is no feature, so the trees learn how far format and context alone tell a span that passes.  They are
fitted to counts of distinct matches per feature pattern, which are taken over all candidates of all documents and bounded by the number of patterns, and
become one SQL expression.

Thresholds come from candidates that the scoring trees have not seen: the candidates are dealt to FOLDS by a hash of the match, so copies of a match
share a fold, and each fold is scored by trees fitted to the others.  Per kind, the lowest score from which on PRECISION of those candidates pass selects
redactions, whether the candidate itself passes or not.  Base spans that pass their checks always stay.

Every text meets the patterns once: the candidates are written as a table, from which trees, thresholds and spans are made.
Patterns are possessive and anchored at the beginning of runs of characters, so that they find what the plain patterns find in linear time and
without recursion on runs of any length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohesia.storage import cut

BASE = ("email", "ip", "card", "phone")
#: Generators in the order of kinds; the first four are the base kinds.
GENERATORS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
    "identity": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "local": r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
}
KINDS = tuple(GENERATORS)
#: Every match but an email holds one of these: a digit and, six or more places on, another in a run of number signs, or a long code.
NEEDS = r"[0-9][\x20().0-9-]{5,}?[0-9]|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20}"
#: Words before a match that announce its kind.
CUES = {
    "email": "mail|contact|write|from|to",
    "ip": "ip|address|host|server|gateway|login",
    "card": "card|visa|mastercard|amex|account|payment|pay",
    "phone": "tel|phone|mobile|fax|call|cell|ring",
    "secret": "token|key|secret|passw(?:or)?d|pwd|auth|api|bearer",
    "identity": "ssn|social|security|identity|passport|tax",
    "local": "tel|phone|mobile|fax|call|cell|ring",
}
#: Features of the match and of the characters beside it; the check of a kind looks at none of them.
FORMAT = {
    "size12": lambda x: x["size"] >= 12,
    "size20": lambda x: x["size"] >= 20,
    "size32": lambda x: x["size"] >= 32,
    "hex": lambda x: F.rlike(x["hit"], F.lit("^[0-9a-fA-F]+$")),
    "upper": lambda x: F.rlike(x["hit"], F.lit("[A-Z]")),
    "lower": lambda x: F.rlike(x["hit"], F.lit("[a-z]")),
    "spaced": lambda x: F.contains(x["hit"], F.lit(" ")),
    "dashed": lambda x: F.contains(x["hit"], F.lit("-")),
    "dotted": lambda x: F.contains(x["hit"], F.lit(".")),
    "bracketed": lambda x: F.contains(x["hit"], F.lit("(")),
    "zero": lambda x: F.startswith(x["hit"], F.lit("0")),
}
BESIDE = {
    "at_start": lambda x: F.rlike(x["before"], F.lit(r"(?:^|\n)\z")),
    "after_space": lambda x: F.endswith(x["before"], F.lit(" ")),
    "after_letter": lambda x: F.rlike(x["before"], F.lit("[A-Za-z]\\z")),
    "after_quote": lambda x: F.rlike(x["before"], F.lit("[\"'`]\\z")),
    "after_assign": lambda x: F.rlike(x["before"], F.lit("[=:] ?[\"'`]?\\z")),
    "after_plus": lambda x: F.rlike(x["before"], F.lit("\\+[0-9]{0,3}[ (.-]*\\z")),
    "then_space": lambda x: (x["after"] == "") | (x["after"] == " ") | (x["after"] == "\n"),
    "then_letter": lambda x: F.rlike(x["after"], F.lit("^[A-Za-z]")),
    "then_quote": lambda x: F.rlike(x["after"], F.lit("^[\"'`]")),
    "then_stop": lambda x: F.rlike(x["after"], F.lit("^[.,;:!?)]")),
}
FEATURES = (*KINDS, *FORMAT, *BESIDE, "own_cue", "other_cue")
ROUNDS, RATE, PRECISION, FOLDS = 30, 0.4, 0.95, 3
#: Additional checks: the interleaved letters and digits of a random string; numbers that are given out.
INTERLEAVED = 4
CHECKS = {
    "identity": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "local": r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[.-][0-9]{4}$",
}
CONTEXT = 24


def _found(kind: str) -> Column:
    """Array of (number, length of the text before since the last match, match, context before, context after)."""
    pattern = F.lit(GENERATORS[kind])
    parts, hits = F.split("text", GENERATORS[kind], -1), F.regexp_extract_all("text", pattern, F.lit(0))
    # Both arrays are bound once, as nothing else keeps an interpreted expression from running again for each use.
    both = F.array(F.struct(hits.alias("hits"), parts.alias("parts")))
    one = lambda p: lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("k"),
        i.alias("i"),
        F.length(F.get(p, i)).alias("gap"),
        x.alias("hit"),
        F.right(F.get(p, i), F.lit(CONTEXT)).alias("before"),
        F.left(F.get(p, i + 1), F.lit(1)).alias("after"),
    )
    every = F.flatten(F.transform(both, lambda y: F.transform(y["hits"], one(y["parts"]))))
    if kind == "email":
        return F.when(F.contains("text", F.lit("@")), every)
    return F.when(F.contains("text", F.lit("+")), every) if kind == "phone" else every


def _luhn(digits: Column) -> Column:
    def add(s, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return s + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def proposals() -> Column:
    """All candidates of the column ``text`` as an array of (k, i, gap, size, mask, passes, hash, valid); null: none.

    A look for what every match holds comes first and spares most texts the patterns.

    ``k`` is the place of the kind in KINDS; ``passes``: whether it passes the check of its kind; ``valid``: a base span that does."""
    asked = F.contains("text", F.lit("@")) | (F.rlike("text", F.lit("[0-9]")) & F.rlike("text", F.lit(NEEDS)))
    hits = F.when(asked, F.flatten(F.array_compact(F.array(*[_found(k) for k in KINDS]))))
    with_digits = F.transform(hits, lambda x: F.struct(*[x[c].alias(c) for c in ("k", "i", "gap", "hit", "before", "after")], F.length(x["hit"]).alias("size"), F.regexp_replace(x["hit"], "[^0-9]", "").alias("digits")))
    octet = lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(x, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    kind = lambda x, name: x["k"] == KINDS.index(name)

    def check(x):
        n = F.length(x["digits"])
        mixture = F.regexp_count(x["hit"], F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")) >= INTERLEAVED
        return (
            F.when(kind(x, "email"), True)
            .when(kind(x, "ip"), F.forall(F.split(x["hit"], r"\."), octet))
            .when(kind(x, "card"), F.when(n.between(14, 19), _luhn(x["digits"])).otherwise(False))
            .when(kind(x, "phone"), n.between(10, 15))
            .when(kind(x, "secret"), mixture)
            .when(kind(x, "identity"), F.rlike(x["hit"], F.lit(CHECKS["identity"])))
            .otherwise(F.rlike(x["hit"], F.lit(CHECKS["local"])))
        )

    def features(x):
        cue = lambda names: F.rlike(x["before"], F.lit(rf"(?i)(?<![a-z])(?:{'|'.join(names)})s?[^A-Za-z0-9]{{0,6}}\z"))
        own = F.lit(False)
        for k in KINDS:
            own = F.when(kind(x, k), cue([CUES[k]])).otherwise(own)
        flags = {k: kind(x, k) for k in KINDS} | {f: g(x) for f, g in (FORMAT | BESIDE).items()} | {"own_cue": own, "other_cue": ~own & cue(CUES.values())}
        return sum((F.when(flags[f], F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")) for b, f in enumerate(FEATURES)), F.lit(0).cast("long"))

    def describe(x):
        return F.struct(*[x[c].alias(c) for c in ("k", "i", "gap", "size")], features(x).alias("mask"), check(x).alias("passes"), F.xxhash64(x["hit"]).alias("hash"))

    return F.transform(F.transform(with_digits, describe), lambda x: x.withField("valid", x["passes"] & (x["k"] < len(BASE))))


class Trees:
    """Boosted trees of two splits over feature bits, fitted to counts per pattern; thresholds per kind from folds left out."""

    def __init__(self, cells: list[tuple[int, int, int, int]]):
        """``cells``: (pattern, fold, candidates, candidates that pass)."""
        masks = sorted({c[0] for c in cells})
        at = {m: i for i, m in enumerate(masks)}
        n, p = np.zeros((2, FOLDS, len(masks)))
        for m, fold, a, b in cells:
            n[fold, at[m]] += a
            p[fold, at[m]] += b
        self.bits = (np.array(masks, dtype=np.int64)[:, None] >> np.arange(len(FEATURES)) & 1).astype(np.float64)
        self.bias, self.trees = self._boost(n.sum(axis=0), p.sum(axis=0))
        held = []
        for fold in range(FOLDS):
            left_out = self._boost(n.sum(axis=0) - n[fold], p.sum(axis=0) - p[fold])
            held += list(zip(self._scores(*left_out), n[fold], p[fold], self.bits, strict=True))
        self.thresholds = [self._threshold([(s, a, b) for s, a, b, bits in held if a and bits[k]]) for k in range(len(KINDS))]

    def _boost(self, n: np.ndarray, p: np.ndarray):
        """``(bias, trees)``; a tree is (first bit, (bit, value without, value with) where it is off, the same where it is on)."""
        bits, trees = self.bits, []
        bias = float(np.log((p.sum() + 1) / (n.sum() - p.sum() + 1)))
        score = np.full(len(n), bias)
        for _ in range(ROUNDS if n.any() else 0):
            q = 1 / (1 + np.exp(-score))
            sums = []
            for v in (p - n * q, n * q * (1 - q)):
                one, both = bits.T @ v, (bits * v[:, None]).T @ bits
                on = np.stack([one[:, None] - both, both], axis=-1)  # first bit on; last axis: second bit off, on
                off = np.stack([v.sum() - one[:, None] - one[None] + both, one[None] - both], axis=-1)
                sums.append(np.stack([off, on], axis=1))  # first bit, off or on, second bit, off or on
            g, h = sums[0], sums[1] + 1
            gain = np.round((g * g / h).sum(axis=-1), 9)
            second = gain.argmax(axis=2)
            first = int(gain.max(axis=2).sum(axis=1).argmax())
            value = np.clip(g / h, -2, 2) * RATE
            tree = (first, *[(int(second[first, s]), float(value[first, s, second[first, s], 0]), float(value[first, s, second[first, s], 1])) for s in (0, 1)])
            trees.append(tree)
            score += self._scores(0.0, [tree])
        return bias, trees

    def _scores(self, bias: float, trees: list) -> np.ndarray:
        out = np.full(len(self.bits), bias)
        for first, *parts in trees:
            leaves = [np.where(self.bits[:, b] > 0, on, off) for b, off, on in parts]
            out += np.where(self.bits[:, first] > 0, leaves[1], leaves[0])
        return out

    @staticmethod
    def _threshold(cells: list[tuple[float, float, float]]) -> float:
        """Lowest score from which on the share that passes is at least PRECISION; none: infinity.  Cells of one score stand or fall together."""
        out, n, p = float("inf"), 0.0, 0.0
        cells = sorted(cells, reverse=True)
        for i, (s, a, b) in enumerate(cells):
            n, p = n + a, p + b
            last = i + 1 == len(cells) or cells[i + 1][0] < s - 1e-9
            if last and p and p >= PRECISION * n:
                out = s
        return out

    def score(self, mask: int) -> float:
        total = self.bias
        for first, *parts in self.trees:
            b, off, on = parts[mask >> first & 1]
            total += on if mask >> b & 1 else off
        return total

    def selects(self, mask: Column, k: Column) -> Column:
        """Whether a candidate is selected."""
        bit = lambda b: mask.bitwiseAND(F.lit(1 << b).cast("long")) != 0
        leaf = lambda part: F.when(bit(part[0]), F.lit(part[2])).otherwise(F.lit(part[1]))
        total = sum((F.when(bit(t[0]), leaf(t[2])).otherwise(leaf(t[1])) for t in self.trees), F.lit(self.bias))
        limit = F.element_at(F.array(*[F.lit(t) for t in self.thresholds]), k + 1)
        return total >= limit - 1e-9


def fit(table: DataFrame) -> Trees:
    """Fit to the candidates of all rows ``(found)``; a match counts once for each pattern, however often it is repeated.  What is collected has one row for each feature pattern and fold, of which there can be
    some 125,000: at most 16 forms of a kind, 8 of size and first digit, 7 x 5 neighbours and 4 of cues."""
    found = table.select(F.explode("found").alias("x")).select("x.mask", "x.hash", "x.passes").distinct()
    cells = found.groupBy("mask", F.pmod("hash", F.lit(FOLDS)).cast("int").alias("fold")).agg(F.count("*").alias("n"), F.sum(F.col("passes").cast("long")).alias("p")).collect()
    return Trees([tuple(r) for r in cells])


def candidates(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``(row, c, found)`` as a table: the columns ``keep`` of a frame in the struct ``c``, and the candidates of its texts."""
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    packed = df.select(kept.alias("c"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return cut(packed.select(F.monotonically_increasing_id().alias("row"), "c", proposals().alias("found")), "pii-candidates")


def spans(table: DataFrame, trees: Trees) -> DataFrame:
    """``(row, k, start, end, valid)`` of base and selected spans of ``(row, found)``; selected ones that overlap a base span are left out.

    Offsets are in code points, ends exclusive.  Spans of one place and different kinds all stay."""
    chosen = lambda x: x["valid"] | trees.selects(x["mask"], x["k"])
    found = table.where(F.exists("found", chosen)).select("row", F.explode("found").alias("x")).select("row", "x.*")
    order = Window.partitionBy("row", "k").orderBy("i")
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order).cast("long")).withColumn("start", F.col("end") - F.col("size"))
    chosen = found.where(F.col("valid") | trees.selects(F.col("mask"), F.col("k"))).select("row", "k", "start", "end", "valid")
    back = Window.partitionBy("row").orderBy("start", "end", "k").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    base_end, base_start = F.when(F.col("valid"), F.col("end")), F.when(F.col("valid"), F.col("start"))
    marked = chosen.withColumn("over", (F.coalesce(F.max(base_end).over(back), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(base_start).over(ahead), F.lit(1 << 60)) < F.col("end")))
    return marked.where("valid or not over").select("row", "k", "start", "end", "valid")


def _listed(only: Column) -> Column:
    """``kind:start:end`` by start, then kind, of the spans for which ``only`` holds."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.collect_list(F.when(only, F.struct("start", "k", "end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"], x["end"])), ",")


def find(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base, spans)`` for every row.

    Null and empty texts have no spans; repeated rows are rows of their own; spans that begin together stand in the order of kinds."""
    table = candidates(df, text, [id_col])
    counts = [F.count(F.when(F.col("valid") & (F.col("k") == i), True)).alias(f"n_{k}") for i, k in enumerate(BASE)]
    by_row = spans(table, fit(table)).groupBy("row").agg(*counts, _listed(F.col("valid")).alias("base"), _listed(F.lit(True)).alias("spans"))
    out = table.select("row", F.col("c.c0").alias("id")).join(by_row, "row", "left")
    return out.select("id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE], F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span replaced by its kind in brackets; overlapping spans are merged under the kind that begins first, of those
    that begin together under the first in the order of kinds.

    Columns and rows stay as they are; null texts stay null.  Only the rows with spans move to be joined with them."""
    table = candidates(df, text, df.columns)
    names = [f"c{i}" for i in range(len(df.columns))]
    at = names[df.columns.index(text)]
    trees = fit(table)
    order = Window.partitionBy("row").orderBy("start", "k", "end")
    found = spans(table, trees).withColumn("new", (F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    found = found.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = found.groupBy("row", "part").agg(F.min(F.struct("start", "k")).alias("first"), F.max("end").alias("end"))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_row = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("first.start").alias("start"), F.col("end"), F.col("first.k").alias("k")))).alias("cuts"))
    has = F.coalesce(F.exists("found", lambda x: x["valid"] | trees.selects(x["mask"], x["k"])), F.lit(False))
    joined = table.where(has).select("row", "c.*").join(by_row, "row", "left")
    whole = F.col(at)
    piece = lambda x, i: F.concat(
        F.substring(whole, F.when(i == 0, 1).otherwise(F.element_at("cuts", F.greatest(i, F.lit(1)))["end"] + 1).cast("int"), (x["start"] - F.when(i == 0, 0).otherwise(F.element_at("cuts", F.greatest(i, F.lit(1)))["end"])).cast("int")),
        F.element_at(kinds, x["k"] + 1),
    )
    ending = F.substring(whole, (F.element_at("cuts", -1)["end"] + 1).cast("int"), F.length(whole))
    rebuilt = F.concat(F.array_join(F.transform("cuts", piece), ""), ending)
    joined = joined.withColumn(at, F.when(F.col("cuts").isNull(), whole).otherwise(rebuilt))
    return joined.select(*names).unionAll(table.where(~has).select("c.*")).toDF(*df.columns)
