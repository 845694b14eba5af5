"""Secret scans: base patterns, and a battery of tests with length-aware false-discovery control, in DataFrame operations only.

Candidates are runs of 20 or more characters that keys are written in. An encoding is inferred from a candidate's characters, and
three statistics are taken in its alphabet: the use of its letters, the runs above and below its middle, and the serial correlation of
neighbours. The battery judges each of them twice:

* against randomness: chi-squared uniformity, runs and serial correlation of uniform letters; where the least p-value, times three,
  falls under `alpha_random`, the candidate is no random key and cannot be a discovery;
* against ordinary writing: the chance that writing of this length in this alphabet, with the letters and pairs of letters of the
  whole corpus, looks at least as random. For the letters it is the likelihood ratio of the G-test, whose inverse bounds that chance
  at every length; for runs and serial correlation it is the chance of coming as near to what uniform letters give. Fisher's method
  combines the three p-values.

The combined p-values pass the Benjamini-Hochberg procedure with weights in proportion to the lengths, which holds the expected share
of false discoveries under `fdr` (for independent or positively dependent candidates, as copies are). It needs only their histogram.
Letters and pairs of letters are counted by Spark over all words of all texts that are too short to be candidates.

Edge cases: a null or empty text has no spans; repeated rows and equal tokens get equal verdicts; very long texts and runs take time
in proportion to their length (times its logarithm); a corpus without candidates has no discoveries; an empty table gives no rows;
extra columns are dropped unless named in `keep`, and may have any name but those of the result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.llm.common import written
from usagelake.llm.spans import SPAN, bound, clear_of, redacted, spans

ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
ASSIGN_NAME = r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}+"
WORD = r"[A-Za-z0-9+/_=-]++"  # of which those under 20 characters are ordinary writing
KINDS = ("assign", "access", "hex", "random")

#: Encodings from the narrowest: pattern and alphabet.
ENCODINGS = (
    (r"^[0-9]+$", "0123456789"),
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (r"^[0-9A-Za-z_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    (r".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
CELLS = 8  # of the histogram, per unit of the logarithm
LEAST = -700.0  # logarithm of a p-value; smaller ones count as this, so that the histogram stays small


def base_spans(text: Column) -> dict[str, Column]:
    value = lambda s: F.length(F.regexp_replace(s["m"], ASSIGN_NAME, ""))
    return {
        "assign": F.filter(spans(text, ASSIGN, text.rlike("[:=]")), lambda s: value(s) >= 6),
        "access": spans(text, ACCESS, text.contains("AKIA")),
        "hex": spans(text, HEX, text.rlike(HEX)),
    }


def letter_pairs(documents: DataFrame) -> list:
    """(a, b, n): how often letter a stands before letter b in the words of the corpus, b being empty at a word's end: at most 67 * 68 rows."""
    word = documents.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).alias("w")).where("length(w) < 20")
    word = word.groupBy("w").agg(F.count("*").alias("n"))
    pair = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.struct(F.substring("w", i, F.lit(1)).alias("a"), F.substring("w", i + 1, F.lit(1)).alias("b")))
    return word.select(F.explode(pair).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).collect()


def writing(pairs: list) -> list[dict]:
    """Per encoding, what ordinary writing in its alphabet is like: odds of each letter under uniform letters against writing's, the
    chance that neighbours lie on different sides of the alphabet's middle, and their correlation. Letters of a case that an alphabet
    lacks count as those of the other: writing in capitals is like other writing."""
    out = []
    for _, alphabet in ENCODINGS:
        k, place = len(alphabet), {c: i for i, c in enumerate(alphabet)}
        place = {c.swapcase(): i for c, i in place.items()} | place
        letters, both = np.full(k, 0.5), np.full((k, k), 0.5 / k)
        for r in pairs:
            if r.a in place:
                letters[place[r.a]] += r.n
                if r.b in place:
                    both[place[r.a], place[r.b]] += r.n
        at, share = np.arange(k), both / both.sum()
        side = at > (k - 1) / 2
        x, y = (share.sum(1) * at).sum(), (share.sum(0) * at).sum()
        spread = math.sqrt((share.sum(1) * (at - x) ** 2).sum() * (share.sum(0) * (at - y) ** 2).sum())
        serial = float((share * np.outer(at - x, at - y)).sum() / spread) if spread > 0 else 0.0
        out.append({"odds": [float(v) for v in np.log(letters.sum() / letters / k)], "turn": float(share[side[:, None] != side[None, :]].sum()), "serial": serial})
    return out


def _erfc_p(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz-Stegun 7.1.26, absolute error under 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = 0.5 * (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _within(low: Column, high: Column) -> Column:
    """The chance of a standard normal between low and high, no less than 1e-12."""
    return F.greatest(F.lit(1e-12), _erfc_p(low) - _erfc_p(high))


def battery(token: Column, ordinary: list[dict]) -> Column:
    """struct<p_random, log_p, n> of one token; meant for the few tokens that are candidates."""
    kinds = [F.struct(F.lit(float(len(letters))).alias("k"), F.lit(letters).alias("alphabet"), F.array(*map(F.lit, o["odds"])).alias("odds"), F.lit(o["turn"]).alias("turn"), F.lit(o["serial"]).alias("serial")) for (_, letters), o in zip(ENCODINGS, ordinary)]
    encoding = kinds[-1]
    for (pattern, _), kind in reversed(list(zip(ENCODINGS[:-1], kinds[:-1]))):
        encoding = F.when(token.rlike(pattern), kind).otherwise(encoding)
    core = F.regexp_replace(token, "=+$", "")
    seen = F.struct(core.alias("core"), encoding.alias("e"))

    def letters(s: Column) -> Column:
        n = F.greatest(F.lit(1), F.length(s["core"])).cast("double")
        count = lambda c: (F.length(s["core"]) - F.length(F.replace(s["core"], c, F.lit("")))).cast("double")
        squares = F.aggregate(F.array_distinct(F.split(s["core"], "")), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(count(c) * count(c)))
        ids = F.transform(F.filter(F.split(s["core"], ""), lambda c: c != ""), lambda c: F.instr(s["e"]["alphabet"], c) - 1)
        return F.struct(s["e"].alias("e"), n.alias("n"), (s["e"]["k"] / n * squares - n).alias("chi2"), ids.alias("ids"))

    def moments(s: Column) -> Column:  # what the tests use inside lambdas is bound here, once
        mid = (s["e"]["k"] - 1) / 2
        after = F.slice(s["ids"], 2, F.size(s["ids"]))
        pairs = F.filter(F.zip_with(s["ids"], after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"].isNotNull())
        n1 = F.aggregate(s["ids"], F.lit(0.0), lambda a, i: a + (i > mid).cast("double"))
        mean = F.aggregate(s["ids"], F.lit(0.0), lambda a, i: a + i) / s["n"]
        odds = F.aggregate(s["ids"], F.lit(0.0), lambda a, i: a + F.coalesce(F.get(s["e"]["odds"], i), F.lit(0.0)))
        return F.struct(*(s[x].alias(x) for x in ("e", "n", "chi2", "ids")), mid.alias("mid"), pairs.alias("pairs"), n1.alias("n1"), mean.alias("mean"), odds.alias("log_ratio"))

    def statistics(s: Column) -> Column:
        n, mean = s["n"], s["mean"]
        turns = F.aggregate(s["pairs"], F.lit(0.0), lambda a, p: a + ((p["a"] > s["mid"]) != (p["b"] > s["mid"])).cast("double"))
        var = F.aggregate(s["ids"], F.lit(0.0), lambda a, i: a + (i - mean) * (i - mean))
        cov = F.aggregate(s["pairs"], F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        return F.struct(*(s[x].alias(x) for x in ("e", "n", "chi2", "n1", "log_ratio")), turns.alias("turns"), F.when(var < 1e-9, 1.0).otherwise(cov / var).alias("serial"))

    def tests(s: Column) -> Column:
        n, df, n1, e = s["n"], s["e"]["k"] - 1, s["n1"], s["e"]
        z_chi = (F.pow(F.greatest(s["chi2"], F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        n2 = n - n1
        mean_runs = 2 * n1 * n2 / n + 1
        var_runs = F.greatest((mean_runs - 1) * (mean_runs - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9))
        z_runs = F.when((n1 < 4) | (n2 < 4), 0.0).otherwise((s["turns"] + 1 - mean_runs) / F.sqrt(var_runs))
        z_serial = s["serial"] * F.sqrt(n)
        least = F.least(_erfc_p(z_chi), 2 * _erfc_p(F.abs(z_runs)), 2 * _erfc_p(F.abs(z_serial)))
        half, off = (n - 1) / 2, F.abs(s["turns"] - (n - 1) / 2) + 0.5
        mean_turns, sd_turns = (n - 1) * e["turn"], F.sqrt(F.greatest((n - 1) * e["turn"] * (1 - e["turn"]), F.lit(0.25)))
        p_runs = _within((half - off - mean_turns) / sd_turns, (half + off - mean_turns) / sd_turns)
        near = F.abs(s["serial"])
        p_serial = _within((-near - e["serial"]) * F.sqrt(n), (near - e["serial"]) * F.sqrt(n))
        evidence = F.greatest(F.lit(0.0), s["log_ratio"]) - F.log(p_runs) - F.log(p_serial)  # Fisher: chi-squared of 6 degrees
        log_p = F.greatest(F.lit(LEAST), F.least(F.lit(0.0), F.log(1 + evidence + evidence * evidence / 2) - evidence))
        return F.struct(F.least(F.lit(1.0), 3 * least).alias("p_random"), log_p.alias("log_p"), n.alias("n"))

    return bound(bound(bound(bound(seen, letters), moments), statistics), tests)


def candidates(documents: DataFrame, ordinary: list[dict], keep: list[str] = ("doc_id",)) -> DataFrame:
    """_kept: struct of the columns `keep`; base: struct of the base spans by kind; cand: array of the candidates outside them with their tests."""
    d = documents.select(F.struct(*(documents[c].alias(c) for c in keep)).alias("_kept") if keep else F.lit(None).cast("string").alias("_kept"), F.coalesce(documents["text"], F.lit("")).alias("_text"))
    found = base_spans(F.col("_text"))
    d = d.select("_kept", F.struct(*(c.alias(k) for k, c in found.items())).alias("base"), spans(F.col("_text"), TOKEN, F.col("_text").rlike(TOKEN)).alias("tokens"))
    free = clear_of(F.col("tokens"), F.concat(*(F.col(f"base.{k}") for k in found)))
    return d.select("_kept", "base", F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), battery(t["m"], ordinary).alias("test"))).alias("cand"))


def _cell(test: Column, alpha_random: float) -> Column:
    """The place of a candidate's weighted p-value in the histogram: of log(p / n), rounded up; null for what is not random."""
    return F.when(test["p_random"] >= alpha_random, F.ceil(CELLS * (test["log_p"] - F.log(test["n"]))))


def discovery_level(cand: DataFrame, fdr: float, alpha_random: float) -> int | None:
    """The largest cell that weighted Benjamini-Hochberg accepts: its p-value, times the mean length, is at most fdr * (accepted / all)."""
    each = cand.select(F.explode("cand.test").alias("t")).groupBy(_cell(F.col("t"), alpha_random).alias("cell")).agg(F.count("*").alias("n"), F.sum("t.n").alias("length"))
    cells = each.orderBy("cell").collect()  # log(p / n) lies between LEAST - 25 and 0: a few thousand rows
    m, above, level = sum(r.n for r in cells), 0, None
    mean = sum(r.length for r in cells) / m if m else 0.0
    for r in cells:
        if r.cell is not None:
            above += r.n
            if r.cell / CELLS + math.log(mean) <= math.log(fdr * above / m):
                level = r.cell
    return level


def _accepted(level: int | None, alpha_random: float) -> Column:
    extra = F.filter("cand", lambda c: F.coalesce(_cell(c["test"], alpha_random) <= F.lit(level), F.lit(False)))
    return F.transform(extra, lambda c: F.struct(F.lit(None).cast("string").alias("m"), c["start"].alias("start"), c["end"].alias("end"))).cast(SPAN)


def scan(documents: DataFrame, fdr: float = 0.01, alpha_random: float = 1e-4, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and assign, access, hex, random: arrays of (m, start, end); random holds what the method adds."""
    cand, _ = written(candidates(documents, writing(letter_pairs(documents)), keep), "secret-candidates")
    level = discovery_level(cand, fdr, alpha_random)
    return cand.select(*(F.col("_kept")[c].alias(c) for c in keep), *(F.col(f"base.{k}").alias(k) for k in KINDS[:3]), _accepted(level, alpha_random).alias("random"))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of these kinds, by start, then kind as listed, comma-joined."""
    def tagged(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("t")))

    each = F.concat(*(tagged(i, k) for i, k in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(each), lambda x: x["t"]), ",")


def redact(documents: DataFrame, mark: str = "[SECRET]", fdr: float = 0.01, alpha_random: float = 1e-4) -> DataFrame:
    """The rows and columns of documents, with every secret replaced by `mark` and n_chars, where there is one, brought up to date.

    The discovery level is found first and the texts are read once more, so that no copy of them has to be written.
    """
    ordinary, columns = writing(letter_pairs(documents)), documents.columns
    level = discovery_level(candidates(documents, ordinary, []), fdr, alpha_random)
    found = candidates(documents, ordinary, columns)
    found = found.select("_kept", F.concat(*(F.col(f"base.{k}") for k in KINDS[:3]), _accepted(level, alpha_random)).alias("spans"))
    out = found.select("_kept", redacted(F.col("_kept")["text"], F.col("spans"), mark).alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.coalesce(F.length("_text").cast("long"), F.col("_kept")["n_chars"].cast("long") if "n_chars" in columns else F.lit(None))}
    return out.select(*(new.get(c, F.col("_kept")[c]).alias(c) for c in columns))
