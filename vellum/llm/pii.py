"""Personal data by weak supervision.

Base spans are those of four fixed patterns and always stay. Further spans come
from looser candidates. Labelers look at every candidate, each at one thing
(the shape, check digits and ranges, gazetteers, words before it, its edges),
and vote for, against or not at all. Expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is for either truth, and
with that how likely each pattern is personal data; a logistic classifier of
votes, kind, length and make-up is trained on those likelihoods and decides
which candidates become spans. The counts are a table of bounded size whatever
the documents.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn")
LABELERS = ("shape", "check", "gazetteer", "context", "edges")

# Gazetteers and cue words.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co ai app dev me us uk de fr es it nl be ch at se no fi dk pl pt ru cn jp kr in br mx ca au nz za eu example test".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98".split())
SECRET_WORDS = frozenset("password passwd pwd passphrase secret token apikey api_key api-key access_key accesskey auth_token private_key client_secret".split())
SECRET_PREFIXES = ("AKIA", "ASIA", "ghp_", "xoxb-", "xoxp-", "sk_live_", "AIza")
CUES = {
    "email": frozenset("email e-mail mail contact write to from correo".split()),
    "ip": frozenset("ip address host server from at login adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit pay tarjeta carte karte".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell whatsapp telefon".split()),
    "secret": SECRET_WORDS | frozenset("key login credentials".split()),
    "ssn": frozenset("ssn social security insurance".split()),
}
AGAINST = frozenset("version v ver release chapter section page fig figure table isbn issn order build ticket no nr".split())
# End of fixed values.

_NUMBER = re.compile("[0-9]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -]?[0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_HIDDEN_AT = re.compile(r" ?[\[(] ?at ?[\])] ?", re.I)
_HIDDEN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]++)+", re.I)
_ASSIGN = re.compile("[=:]")
_KEY = re.compile(r"([A-Za-z_-]{2,24})[\"']?[ \t]?$")
_QUOTED = re.compile(r"[ \t]?(?:\"([^\"\s]{6,}+)\"|'([^'\s]{6,}+)')")
_BARE = re.compile(r"[^\s\"',;]++")
_PREFIXED = re.compile(r"[A-Za-z0-9_-]{8,}+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_CUE = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, leftmost and not overlapping. Every
    match holds an @ right behind its first part, so the @ are looked for and
    the parts grown from there, in linear time."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def found(text: str) -> list[tuple[int, int, int, bool]]:
    """Candidates (kind, start, end, base), base ones of each kind first and
    from left to right."""
    base: dict[int, list] = {k: [] for k in range(4)}
    loose: list[tuple[int, int, int, bool]] = []
    base[0] = [(0, a, b, True) for a, b in emails(text)]
    ip_end = card_end = 0
    for m in _NUMBER.finditer(text):
        at = m.start()
        if at >= ip_end and text[m.end() : m.end() + 1] == "." and (hit := _IP.match(text, at)):
            ip_end = hit.end()
            # a part of more than ten digits may be zeros: compare as text
            good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in hit[0].split("."))
            (base[1] if good else loose).append((1, at, ip_end, good))
        if at >= card_end:
            hit = _CARD.match(text, at)
            card_end = hit.end()
            if card_end - at >= 13:
                digits = hit[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    base[2].append((2, at, card_end, True))
                elif 13 <= len(digits) <= 19:
                    loose.append((2, at, card_end, False))
        if m.end() - at == 3:
            if (hit := _SSN.match(text, at)) and text[max(0, at - 1) : at] != "-":
                loose.append((5, at, hit.end(), False))
            if hit := _LOCAL_PHONE.match(text, at):
                loose.append((3, at - (text[max(0, at - 1) : at] == "(" and ")" in hit[0]), hit.end(), False))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum(c.isdecimal() for c in m[0])
            good = 8 <= n <= 15
            (base[3] if good else loose).append((3, m.start(), m.end(), good))
    last = 0
    for m in _HIDDEN_AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (hit := _HIDDEN_DOMAIN.match(text, m.end())):
            last = hit.end()
            loose.append((0, start, last, False))
    bare_end = 0
    for m in _ASSIGN.finditer(text):
        if (key := _KEY.search(text, max(0, m.start() - 28), m.start())) and key[1].lower() in SECRET_WORDS:
            if value := _QUOTED.match(text, m.end()):
                loose.append((4, *value.span(value.lastindex), False))
                continue
            at = m.end() + (text[m.end() : m.end() + 1] in (" ", "\t"))
            # a run that holds several marks is walked once
            if at >= bare_end:
                bare_end = hit.end() if (hit := _BARE.match(text, at)) else at
            if bare_end - at >= 6:
                loose.append((4, at, bare_end, False))
    for prefix in SECRET_PREFIXES:
        at = text.find(prefix)
        while at >= 0:
            # a glued one is passed without a walk over its run, which others may begin in
            hit = _PREFIXED.match(text, at) if at == 0 or not text[at - 1].isalnum() else None
            if hit:
                loose.append((4, at, hit.end(), False))
            at = text.find(prefix, hit.end() if hit else at + 1)
    firm = [x for k in range(4) for x in base[k]]
    if loose:
        taken: dict[int, list[tuple[int, int]]] = {}
        for k, a, b, _ in firm:
            taken.setdefault(k, []).append((a, b))
        for x in sorted(set(loose), key=lambda x: (x[0], x[1], -x[2])):
            own = taken.setdefault(x[0], [])
            if not _meets(own, x[1], x[2]):
                own.append((x[1], x[2]))
                own.sort()
                firm.append(x)
    return firm


def _meets(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) overlaps one of the sorted spans, which don't overlap."""
    from bisect import bisect_left

    i = bisect_left(spans, (b, b))
    return i > 0 and spans[i - 1][1] > a


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def votes(text: str, kind: int, a: int, b: int, base: bool) -> tuple[int, ...]:
    """Each labeler's vote, 1 for, -1 against, 0 none."""
    s = text[a:b]
    digits = "".join(c for c in s if c in "0123456789")
    before = text[max(0, a - 48) : a]
    cues = [w.lower() for w in _CUE.findall(before)[-3:]]
    name = KINDS[kind]
    shape = 1 if base or kind == 5 or kind == 4 and len(s) >= 12 else 0
    if kind == 0:
        top = re.split(r"[. \])]", s.rstrip("])"))[-1].lower()
        check, gazetteer = (1 if top.isalpha() and len(top) > 1 else -1), (1 if top in TOP_DOMAINS else 0)
    elif kind == 1:
        parts = [p.lstrip("0") or "0" for p in s.split(".")]
        check = 1 if all(len(p) <= 3 and int(p) <= 255 for p in parts) else -1
        gazetteer = -1 if parts[0] in ("0", "127", "255") else 0
    elif kind == 2:
        check, gazetteer = (1 if luhn(digits) else -1), (1 if digits[0] in "3456" else -1)
    elif kind == 3:
        check = 1 if 8 <= len(digits) <= 15 else -1
        gazetteer = 1 if s[0] == "+" and any(digits[:n] in COUNTRY_CODES for n in (1, 2)) else 0
    elif kind == 4:
        mixed = bool(digits) and any(c.isalpha() for c in s)
        check = 1 if mixed and _entropy(s) >= 2.5 else -1
        gazetteer = 1 if s.startswith(SECRET_PREFIXES) or any(w in SECRET_WORDS for w in cues) else 0
    else:
        check, gazetteer = (-1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[-4:] == "0000" else 1), 0
    context = -1 if cues and cues[-1] in AGAINST else 1 if any(w in CUES[name] for w in cues) else 0
    left, right = text[a - 1 : a] if a else "", text[b : b + 1]
    tied = left.isalnum() or right.isalnum() or left in tuple("_/-") or right in tuple("_/-") or right == "." and text[b + 1 : b + 2].isalnum()
    return shape, check, gazetteer, context, -1 if tied else 1


def pattern_of(text: str, kind: int, a: int, b: int, base: bool) -> int:
    """Kind, votes, length and share of digits, as one number."""
    p = kind
    for v in votes(text, kind, a, b, base):
        p = p * 3 + v + 1
    share = sum(c in "0123456789" for c in text[a:b]) / (b - a)
    return (p * 4 + min(3, int(math.log2(b - a) / 1.5))) * 4 + min(3, int(share * 4))


def opened(pattern: int) -> tuple[int, tuple[int, ...], int, int]:
    pattern, share = divmod(pattern, 4)
    pattern, size = divmod(pattern, 4)
    v = []
    for _ in LABELERS:
        pattern, x = divmod(pattern, 3)
        v.append(x - 1)
    return pattern, tuple(reversed(v)), size, share


class SpanModel:
    """Labelers' reliabilities by expectation-maximisation, and the classifier
    trained on what they say."""

    def __init__(self, counts: dict[int, int], rounds: int = 60):
        self.patterns = sorted(counts)
        n = np.array([counts[p] for p in self.patterns], float)
        parts = [opened(p) for p in self.patterns]
        kinds = np.array([x[0] for x in parts], int)
        cast = np.array([x[1] for x in parts], int).reshape(len(parts), len(LABELERS)) + 1
        # to begin with a labeler is right three times of four when it votes
        like = 1 / (1 + np.exp(-(cast - 1).sum(axis=1) * math.log(3)))
        self.reliability = np.full((2, len(LABELERS), 3), 1 / 3)
        prior = np.full(len(KINDS), 0.5)
        for _ in range(rounds if len(n) else 0):
            for y, w in ((0, n * (1 - like)), (1, n * like)):
                for k in range(len(LABELERS)):
                    # as many pseudo-votes, more of them right than wrong, as
                    # keep a labeler's meaning from turning over
                    own = np.bincount(cast[:, k], w, 3) + np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]][y])
                    self.reliability[y, k] = own / own.sum()
            for k in range(len(KINDS)):
                mine = kinds == k
                prior[k] = (n[mine] @ like[mine] + 1) / (n[mine].sum() + 2)
            logs = [np.log(self.reliability[y, np.arange(len(LABELERS)), cast]).sum(axis=1) + np.log(prior[kinds] if y else 1 - prior[kinds]) for y in (0, 1)]
            new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
            done = np.abs(new - like).max() < 1e-9
            like = new
            if done:
                break
        self.likelihood = dict(zip(self.patterns, like.tolist()))
        x = np.array([self._row(p) for p in self.patterns]).reshape(len(parts), -1) if parts else np.zeros((0, 1))
        self.weights = np.zeros(x.shape[1])
        pull = np.eye(x.shape[1])
        for _ in range(30 if len(n) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull, x.T @ (n * (like - p)) - self.weights)
            self.weights += step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
            if np.abs(step).max() < 1e-8:
                break

    @staticmethod
    def _row(pattern: int) -> list[float]:
        kind, cast, size, share = opened(pattern)
        return [1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(v == s) for v in cast for s in (-1, 1)), *(float(size == k) for k in range(4)), *(float(share == k) for k in range(4))]

    def accepts(self, pattern: int) -> bool:
        return pattern in self.likelihood and float(np.dot(self._row(pattern), self.weights)) > 0


def candidates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, cands): every document's candidates with their patterns."""
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32())])

    def make():
        def apply(ids, texts):
            rows = [[{"kind": k, "start": a, "end": b, "base": base, "pattern": pattern_of(t, k, a, b, base)} for k, a, b, base in found(t)] for t in texts]
            return {"doc_id": ids, "cands": pa.array(rows, pa.list_(kind))}

        return apply

    return common.map_documents(common.documents(df, id_col, text_col), make, "doc_id long, cands array<struct<kind:int,start:int,end:int,base:boolean,pattern:int>>")


def learn(cands: DataFrame) -> SpanModel:
    """The model from all candidates; what reaches the driver is a count for
    each pattern, of which there are a bounded number."""
    counts = cands.select(F.explode("cands.pattern").alias("pattern")).groupBy("pattern").count()
    return SpanModel({r["pattern"]: r["count"] for r in counts.collect()})


def personal_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>) for every row:
    base spans and those that the classifier adds, by kind as listed, then
    start. Places are code points, end exclusive.

    Candidates are found in one pass and written to the shared folder;
    learning and the decisions read them. A null or empty text has no spans, a
    text of any length is searched whole. Repeated rows each have a row and count in learning, a null doc_id stays
    null, other columns are not looked at, an empty table gives an empty one.
    """
    cands = common.stored(candidates(df, id_col=id_col, text_col=text_col), "pii")
    model = learn(cands)
    kept = [p for p in model.patterns if model.accepts(p)]
    chosen = F.array(*[F.lit(p) for p in kept]) if kept else F.array().cast("array<int>")
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.filter("cands", lambda c: c["base"] | F.array_contains(chosen, c["pattern"]))
    spans = F.array_sort(spans, lambda x, y: F.when(x["kind"] != y["kind"], x["kind"] - y["kind"]).otherwise(x["start"] - y["start"]).cast("int"))
    return cands.select("doc_id", F.transform(spans, lambda c: F.struct(F.element_at(names, c["kind"] + 1).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))).alias("spans"))


def redact(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``df`` with every span that ``personal_spans`` finds replaced by its
    kind in angle brackets, and ``length_col``, if there, the new length of
    the text. Candidates are found once and written beside the rows, so
    nothing is joined to the texts.

    A null text stays null, an empty one empty, a text of any length is
    searched whole; repeated rows each stay and count in learning, a null id
    stays, other columns may have any names, an empty table gives an empty
    table."""
    (at,) = common.unused(df, 1)

    def make():
        # as "kind start end base pattern", which keeps the rows narrow
        return lambda texts: [[f"{k} {a} {b} {int(base)} {pattern_of(t, k, a, b, base)}" for k, a, b, base in found(t)] for t in texts]

    text = F.col(text_col).cast("string")
    rows = common.stored(df.withColumn(at, common.per_text(make, "array<string>")(text)), "pii")
    part = lambda c, k: F.split(c, " ")[k].cast("int")
    model = learn(rows.select(F.transform(at, lambda c: F.struct(part(c, 4).alias("pattern"))).alias("cands")))
    kept = [p for p in model.patterns if model.accepts(p)]
    chosen = F.array(*[F.lit(p) for p in kept]) if kept else F.array().cast("array<int>")
    spans = F.filter(F.col(at), lambda c: (part(c, 3) == 1) | F.array_contains(chosen, part(c, 4)))

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            if text is not None and own is not None and len(own):
                text = redacted(text, [(KINDS[int(k)], int(a), int(b)) for k, a, b, *_ in (x.split() for x in own)])
            out.append(text)
        return pd.Series(out, dtype=object)

    out = rows.withColumn(text_col, clean(text, spans)).drop(at)
    return out.withColumn(length_col, F.char_length(text_col).cast(df.schema[length_col].dataType)) if length_col in df.columns else out


def digest(found_spans: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts
    and hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda c: c["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")
    of = lambda kind: lambda c: c["kind"] == kind
    return found_spans.select(
        "doc_id",
        *(F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones together, replaced by its
    kind in angle brackets."""
    out, at, i = [], 0, 0
    spans = sorted(spans, key=lambda s: (s[1], -s[2]))
    while i < len(spans):
        kind, a, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def sha256_of_base(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
