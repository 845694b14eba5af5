"""Personal data by weak supervision, in DataFrame operations only.

Strict patterns give the base spans (email, ip, card, phone). Looser patterns propose further candidates of these kinds and names
after a form of address. Labelers vote on every candidate, base ones included: the strict pattern, a gazetteer, the words before it,
its shape, and its borders. The gazetteer is the corpus's own: the mail domains, address blocks, issuer and dialling prefixes and family
names that at least `least` candidates share, beside a few generally known ones. Expectation-maximisation over the vote patterns of the
whole corpus (a two-class model with one confusion table per labeler) estimates the labelers' reliabilities; its posteriors train a
logistic span classifier on votes and length, which decides on the candidates. Entries and vote patterns are counted by Spark; the
driver sees at most `GAZETTEER_SIZE` entries a kind and one row per kind and pattern.

Edge cases: a null or empty text has no spans; repeated rows and equal matches are judged alike; a candidate that overlaps a base span
is not added; a corpus without candidates trains nothing and adds nothing; an empty table gives no rows; extra columns are dropped
unless named in `keep`, and may have any name but those of the result. Patterns are possessive, so that long runs take linear time;
a text with very many matches takes time in proportion to them (times their logarithm).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.llm.common import written
from usagelake.llm.spans import blocks, bound, clear_of, digits, luhn, piece, spans

#: The base patterns. A match can only begin where a run of its first class begins or the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "name")

#: Looser patterns, by the kind they propose.
LOOSE = (
    ("email", r"[A-Za-z0-9._%+-]++(?:\x20?[\[(](?:at|AT)[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++", r"(?i)[\[(](?:at|dot)[\])]|\x20dot\x20"),
    ("phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"[0-9]{4}"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){12,18}", r"[0-9]{3}"),
    ("name", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?", r"Mr|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor"),
)
#: Generally known entries of the gazetteer: top-level domains, private address blocks, issuer and dialling prefixes.
KNOWN = {"email": ("com", "org", "net", "edu", "gov"), "ip": ("10", "127", "172", "192"), "card": ("34", "37", "41", "45", "51", "52", "53", "54", "55", "60"), "phone": ("+1", "+33", "+34", "+44", "+49"), "name": ()}
GAZETTEER_SIZE = 1000  # most frequent entries of a kind that are learned
#: Words before a match that speak for its kind, and words that speak against any kind.
CUES = {"email": r"(?i)e-?mail|contact|write|reach|address", "ip": r"(?i)\bip\b|host|server|address|from", "card": r"(?i)card|visa|payment|credit|account", "phone": r"(?i)phone|\btel|call|mobile|fax|contact", "name": r"(?i)name|dear|signed|contact|by"}
AGAINST = r"(?i)version|isbn|order|invoice|serial|build|\bno\.|#|\$|€|page"
LABELERS = ("strict", "gazetteer", "context", "shape", "border")


def base_spans(text: Column) -> dict[str, Column]:
    part_ok = lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.regexp_replace(p, "^0+(?=.)", "").cast("string").try_cast("int") <= 255)
    size = lambda s, a, b: F.length(digits(s["m"])).between(a, b)
    digit = text.rlike("[0-9]")
    return {
        "email": spans(text, EMAIL, text.contains("@")),
        "ip": F.filter(spans(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: F.forall(F.split(s["m"], r"\."), lambda p: F.coalesce(part_ok(p), F.lit(False)))),
        "card": F.filter(spans(text, CARD, digit), lambda s: F.when(size(s, 13, 19), luhn(digits(s["m"]))).otherwise(False)),
        "phone": F.filter(spans(text, PHONE, text.contains("+")), lambda s: size(s, 9, 15)),
    }


def _by_kind(kind: Column, table: dict[str, str], text: Column) -> Column:
    out = F.lit(False)
    for k, p in table.items():
        out = F.when(kind == k, text.rlike(p)).otherwise(out)
    return out


def _entry(kind: Column, m: Column) -> Column:
    """array<string>: what of a match the gazetteer may know."""
    low, d = F.lower(m), digits(m)
    host = F.split(F.regexp_replace(low, r"\x20?[\[(]dot[\])]\x20?|\x20dot\x20", "."), r"\.")
    return (
        F.when(kind == "email", F.array(F.element_at(host, -1), F.concat_ws(".", F.regexp_extract(F.coalesce(F.try_element_at(host, F.lit(-2)), F.lit("")), "[a-z0-9-]+$", 0), F.element_at(host, -1))))
        .when(kind == "ip", F.array(F.substring_index(m, ".", 1), F.substring_index(m, ".", 2)))
        .when(kind == "card", F.array(F.substring(d, 1, 2), F.substring(d, 1, 4)))
        .when(kind == "phone", F.filter(F.array(*(F.when(m.startswith("+"), F.concat(F.lit("+"), F.substring(d, 1, n))) for n in (1, 2)), F.substring(d, -10, 3)), lambda e: e.isNotNull()))
        .otherwise(F.slice(F.split(low, r"\x20"), 2, 2))
    )


def _votes(s: Column, parts: Column) -> Column:
    """struct of the labelers' votes (-1, 0, 1) on one candidate s of a text in blocks, but for the gazetteer's."""
    before = piece(parts, F.greatest(F.lit(0), s["start"] - 32), s["start"])
    sign = lambda yes, no: F.when(no, -1).when(yes, 1).otherwise(0)
    same = digits(s["m"]).rlike(r"^(\d)\1{7,}$|01234567|12345678|98765432")
    edge = F.concat(piece(parts, F.greatest(F.lit(0), s["start"] - 1), s["start"]), F.lit(" "), piece(parts, s["end"], s["end"] + 1))
    return F.struct(
        F.when(s["strict"], 1).otherwise(0).alias("strict"),
        bound(before, lambda b: sign(_by_kind(s["kind"], CUES, b), b.rlike(AGAINST))).alias("context"),
        F.when(same, -1).otherwise(1).alias("shape"),
        F.when(edge.rlike(r"[\p{L}\p{N}_]"), -1).otherwise(1).alias("border"),
    )


def candidates(documents: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """_kept: struct of the columns `keep`; base: struct of arrays of base spans; cand: array of struct(kind, start, end, strict, size, entry, votes)."""
    d = documents.select(F.struct(*(documents[c].alias(c) for c in keep)).alias("_kept"), F.coalesce(documents["text"], F.lit("")).alias("_text"))
    t, found = F.col("_text"), base_spans(F.col("_text"))
    loose = [spans(t, p, t.rlike(need)).alias(f"_l{i}") for i, (_, p, need) in enumerate(LOOSE)]
    d = d.select("_kept", "_text", F.struct(*(c.alias(k) for k, c in found.items())).alias("base"), *loose)
    taken = F.concat(*(F.col(f"base.{k}") for k in found))
    as_cand = lambda kind, strict: lambda s: F.struct(F.lit(kind).alias("kind"), s["m"].alias("m"), s["start"].alias("start"), s["end"].alias("end"), F.lit(strict).alias("strict"))
    cand = F.concat(*(F.transform(f"base.{k}", as_cand(k, True)) for k in found), *(F.transform(clear_of(F.col(f"_l{i}"), taken), as_cand(kind, False)) for i, (kind, *_) in enumerate(LOOSE)))
    size = lambda m: F.least(F.lit(4), F.length(m) / 8).cast("int")
    voted = lambda x: F.transform(x["cand"], lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["strict"].alias("strict"), size(s["m"]).alias("size"), _entry(s["kind"], s["m"]).alias("entry"), _votes(s, x["parts"]).alias("votes")))
    d = d.select("_kept", "_text", "base", cand.alias("cand"))
    parts = F.when(F.size("cand") > 0, blocks(t)).otherwise(F.array().cast("array<string>"))
    cand = bound(F.struct(F.col("cand").alias("cand"), parts.alias("parts")), voted)
    return d.select("_kept", F.struct(*(F.transform(f"base.{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in found)).alias("base"), cand.alias("cand"))


def gazetteer(cand: DataFrame, least: int = 3) -> dict[str, list[str]]:
    """Entries by kind: the known ones and those of the most candidates, `least` at least."""
    from pyspark.sql import Window

    each = cand.select(F.explode("cand").alias("c")).select("c.kind", F.explode(F.array_distinct("c.entry")).alias("entry")).where("entry <> ''")
    n = each.groupBy("kind", "entry").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = n.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "entry"))).where(F.col("rank") <= GAZETTEER_SIZE)
    out = {k: list(KNOWN[k]) for k in KINDS}
    for r in top.select("kind", "entry").collect():
        out[r.kind].append(r.entry)
    return {k: sorted(set(v)) for k, v in out.items()}


def with_gazetteer(cand: DataFrame, entries: dict[str, list[str]]) -> DataFrame:
    """The candidates with the gazetteer's vote beside the others."""

    def among(v: list[str]):
        return lambda e: e.isin(v)

    def known(c: Column) -> Column:
        out = F.lit(False)
        for k, v in entries.items():
            if v:
                out = F.when(c["kind"] == k, F.exists(c["entry"], among(v))).otherwise(out)
        return out

    full = lambda c: F.struct(*(c[x].alias(x) for x in ("kind", "start", "end", "strict", "size")), F.struct(c["votes"]["strict"].alias("strict"), F.coalesce(known(c), F.lit(False)).cast("int").alias("gazetteer"), *(c["votes"][x].alias(x) for x in LABELERS[2:])).alias("votes"))
    return cand.withColumn("cand", F.transform("cand", full))


def patterns(cand: DataFrame) -> list:
    """Counted vote patterns: at most kinds * 5 sizes * 2 * 2 * 3 * 2 * 2 rows."""
    c = cand.select(F.explode("cand").alias("c")).select("c.kind", "c.size", *(F.col(f"c.votes.{x}").alias(x) for x in LABELERS))
    return c.groupBy("kind", "size", *LABELERS).agg(F.count("*").alias("n")).orderBy("kind", "size", *LABELERS).collect()


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """EM of a two-class model with conditionally independent labelers: posteriors of the patterns, P(vote | class) and the prior."""
    post = 1 / (1 + np.exp(-1.5 * (votes.sum(1) - 1.5)))
    table, prior = np.zeros((votes.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        w = np.stack([1 - post, post], 1) * n[:, None]
        prior = (w[:, 1].sum() + 1) / (w.sum() + 2)
        for j in range(votes.shape[1]):
            for v in range(3):
                table[j, :, v] = (w[votes[:, j] == v - 1].sum(0) + 1) / (w.sum(0) + 3)
        log = np.log([1 - prior, prior])[None, :] + sum(np.log(table[j][:, votes[:, j] + 1].T) for j in range(votes.shape[1]))
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return post, table, prior


def _features(kind: str, size: int, votes: list[int]) -> np.ndarray:
    return np.array([1.0, *votes, *(kind == k for k in KINDS), *(size == i for i in range(5))], float)


def train(rows: list, rounds: int = 400) -> np.ndarray | None:
    """Weights of the logistic span classifier, fitted to the posteriors of the counted patterns."""
    if not rows:
        return None
    votes, n = np.array([[r[x] for x in LABELERS] for r in rows]), np.array([r.n for r in rows], float)
    post, *_ = reliabilities(votes, n)
    x = np.stack([_features(r.kind, r["size"], [r[v] for v in LABELERS]) for r in rows])
    w, share = np.zeros(x.shape[1]), np.sqrt(n) / np.sqrt(n).sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (share * (p - post)) + 1e-4 * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= 0.5 * np.linalg.solve(hess, grad)
    return w


def probability(c: Column, w: np.ndarray) -> Column:
    """The classifier's probability of one candidate."""
    z = F.lit(float(w[0]))
    for x, v in zip(w[1:], LABELERS):
        z = z + float(x) * c["votes"][v]
    for x, k in zip(w[1 + len(LABELERS) :], KINDS):
        z = z + F.when(c["kind"] == k, float(x)).otherwise(0.0)
    for i, x in enumerate(w[1 + len(LABELERS) + len(KINDS) :]):
        z = z + F.when(c["size"] == i, float(x)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find(documents: DataFrame, level: float = 0.5, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, base: struct of arrays of (start, end) by kind, and added: array of (kind, start, end, probability)."""
    cand, _ = written(candidates(documents, keep), "pii-candidates")
    cand = with_gazetteer(cand, gazetteer(cand))
    w = train(patterns(cand))
    added = F.filter("cand", lambda c: ~c["strict"])
    scored = F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), (probability(c, w) if w is not None else F.lit(0.0)).alias("probability")))
    return cand.select(*(F.col("_kept")[c].alias(c) for c in keep), "base", F.filter(scored, lambda s: s["probability"] >= level).alias("added"))


def listed(base_only: bool) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    def tagged(i: int, kind: str, spans_: Column) -> Column:
        return F.transform(spans_, lambda s: F.struct(F.lit(i).alias("i"), s["start"].alias("start"), s["end"].alias("end"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("t")))

    def of_kind(kind: str) -> Column:
        return F.filter("added", lambda s: s["kind"] == kind)

    parts = [tagged(i, k, F.col(f"base.{k}")) for i, k in enumerate(KINDS[:4])]
    if not base_only:
        parts += [tagged(i, k, of_kind(k)) for i, k in enumerate(KINDS)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda x: x["t"]), ",")
