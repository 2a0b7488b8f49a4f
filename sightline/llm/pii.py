"""Personal data and secrets by weak supervision.

Candidates are spans of five kinds: the four base patterns (email, ip, card, phone), wider forms of them
(written-out mail addresses, addresses with bracketed dots, national phone formats, grouped card numbers,
numbers in a labelled field), and secrets (values assigned to a field that is named like one, and long mixed runs of
letters and digits). Five labelers vote on each: base pattern or assignment, check digit, range or
entropy, gazetteer (top-level domains, calling codes, card issuers, prefixes and field names of keys),
context words, and the shape of what surrounds the span. Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability per kind. A logistic span classifier is then trained on the
resulting soft labels from the votes and from features of the span itself (length, share of digits,
separators, mixed case, what stands before it), weighted by counts; a candidate is added where the
classifier is at least ``ACCEPT`` sure and it overlaps no base span of its kind. Votes and features are
letters of one code, so all that is collected is the count of each code, of at most ``MOST_CODES`` different ones.

Base spans are leftmost and non-overlapping per kind; a failing match is dropped, not retried; they
always stay. Offsets are code points, ends exclusive. Every pattern runs in time linear in the text, however long.

Defined results: null text is empty and has no spans (the digest is that of the empty string); without
any candidate nothing is trained; of added spans of a kind that overlap, the first found (base forms, wider
forms, fields, then runs; leftmost first) stays; repeated rows and null ids each get a row; an empty table
gives none. Only the id and text columns are read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans; those of the base come first.
ALL_KINDS = (*KINDS, "secret")
SECRET = 4
ACCEPT = 0.9
AROUND = 40
#: Kinds, votes of five labelers, and features.
MOST_CODES = 5 * 3**5 * 3 * 3 * 3 * 2 * 3

# The base patterns, in forms that match the same spans in linear time: a match can only begin where a run of digits does.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# The wider patterns.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?i:\[at\]|\(at\)|\{at\}|(?<= )at(?= )) ?[A-Za-z0-9-]++(?: ?(?i:\[dot\]|\(dot\)|\{dot\}|(?<= )dot(?= )|\.) ?[A-Za-z0-9-]{2,}+)++")
_BRACKETED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[\[({]\.[\])}] ?[0-9]{1,3}){3}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9+.])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])00[1-9][0-9]{0,2}[ -][0-9][ 0-9-]{5,14}[0-9]")
_GROUPED = re.compile(r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])")
_FIELD = re.compile(r"""[:=][ \t]{0,3}["']?([^\s"'<>;,]{6,}+)""")
_FIELD_NAME = re.compile(r"""([A-Za-z][A-Za-z_-]*)["']?[ \t]*\Z""")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
_DIGIT = re.compile("[0-9]")

#: Gazetteers and context words.
DOMAINS = frozenset("com org net edu gov mil int info biz io co me app dev eu de fr es it uk us ca nl be ch at pl pt se no dk fi ru cn jp kr in br mx ar au nz za".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "6011", "65", "35", "36", "30")
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "351", "352", "353", "358", "359", "380", "420", "421", "852", "886", "966", "971", "972")
CUES = {
    "email": ("mail", "contact", "write to", "correo", "kontakt", "courriel"),
    "ip": ("ip", "server", "host", "address", "client", "login"),
    "card": ("card", "visa", "master", "amex", "credit", "payment", "tarjeta", "karte", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "llam", "anruf", "appel"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "api", "auth", "bearer", "credential", "private key", "login", "clave", "passwort", "mot de passe"),
}
AGAINST = {"email": ("regex", "example of"), "ip": ("version", "release", "section", "chapter"), "card": ("isbn", "order", "serial", "id ", "hash"), "phone": ("isbn", "order", "serial", "part no"), "secret": ("checksum", "commit", "sha256", "sha1", "md5", "digest", "isbn", "http", "www")}
#: Words in the names of fields that hold secrets, of fields that hold numbers by kind, and prefixes of issued keys.
SECRET_FIELDS = frozenset("token secret password passwd pwd passphrase apikey key credential credentials auth authorization bearer".split())
NUMBER_FIELDS = {"ip": 1, "host": 1, "server": 1, "card": 2, "visa": 2, "mastercard": 2, "creditcard": 2, "phone": 3, "tel": 3, "telephone": 3, "telefon": 3, "mobile": 3, "fax": 3, "cell": 3}
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "pk_live_", "rk_live_", "xox", "AIza", "ya29", "eyJ", "npm_", "SG")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the four base patterns."""
    found = []
    if "@" in text:
        last = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def wider_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beyond the base spans: of each kind non-overlapping, and clear of the kind's base spans."""
    found = []
    if "at" in text or "AT" in text or "At" in text:
        found += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text) if " at " not in m[0].lower() or "dot" in m[0].lower()]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _BRACKETED.finditer(text)]
        found += [(m.start(), 3, m.end()) for m in _NATIONAL.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _GROUPED.finditer(text)]
        for m in _FIELD.finditer(text):
            name = _FIELD_NAME.search(text, max(0, m.start() - 32), m.start())
            words = set(re.split("[_-]", name[1].lower())) if name else set()
            digits = sum("0" <= c <= "9" for c in m[1][:40])
            if words & SECRET_FIELDS:
                found.append((m.start(1), 4, m.end(1)))
            for word in words & NUMBER_FIELDS.keys():
                if digits >= 7 and digits >= 0.6 * len(m[1]):
                    found.append((m.start(1), NUMBER_FIELDS[word], m.end(1)))
        found += [(m.start(), 4, m.end()) for m in _RUN.finditer(text) if _mixes(m[0])]
    kept: list[tuple[int, int, int]] = []
    ends: dict[int, list[tuple[int, int]]] = {}
    for start, kind, end in base:
        ends.setdefault(kind, []).append((start, end))
    for start, kind, end in found:
        taken = ends.setdefault(kind, [])
        at = bisect.bisect_left(taken, (start, start))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
            taken.insert(at, (start, end))
            kept.append((start, kind, end))
    return sorted(kept)


def _mixes(run: str) -> bool:
    """Whether a long run has at least 3 digits and 3 letters."""
    digits = letters = 0
    for c in run:
        digits += "0" <= c <= "9"
        letters += c.isalpha()
        if digits >= 3 and letters >= 3:
            return True
    return False


def _entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def code(text: str, span: tuple[int, int, int], is_base: bool) -> str:
    """The kind's number, a letter a labeler (y for, n against, - no opinion; pattern, check, gazetteer, context, shape), a letter a feature."""
    start, kind, end = span
    value = text[start:end]
    digits = "".join(c for c in value if c.isascii() and c.isdigit())
    around = text[max(0, start - AROUND) : end + AROUND].lower()
    before, after = text[start - 1 : start], text[end : end + 1]
    if kind == 0:
        check = "y" if ".." not in value and not value.startswith(".") else "n"
        last = re.split(r"[^A-Za-z0-9]+", value.rstrip("])}"))[-1].lower()
        known = "y" if last in DOMAINS else "n" if last.isdigit() else "-"
    elif kind == 1:
        parts = re.findall("[0-9]+", value)
        check = "n" if len(parts) != 4 or any(len(p) > 1 and p[0] == "0" or len(p) > 3 or int(p) > 255 for p in parts) else "y"
        known = "n" if parts[:1] == ["0"] or len(set(parts)) <= 1 else "-"
    elif kind == 2:
        check = "y" if 12 <= len(digits) <= 19 and _luhn(digits) else "n"
        known = "y" if digits.startswith(ISSUERS) else "n"
    elif kind == 3:
        check = "y" if 7 <= len(digits) <= 15 else "n"
        known = "y" if (value.startswith("+") and digits.startswith(CODES)) or (value.startswith("00") and digits[2:].startswith(CODES)) or (not value.startswith(("+", "00")) and digits[:1] > "0") else "-"
    else:
        check = "y" if _entropy(value) >= 3 else "n"
        name = _FIELD_NAME.search(text[max(0, start - 36) : start].rstrip("\"' \t:="))
        known = "y" if value.startswith(PREFIXES) or name and not SECRET_FIELDS.isdisjoint(re.split("[_-]", name[1].lower())) else "-"
    pattern = is_base or kind == 4 and before in ("'", '"', ":", "=") and before != ""
    cues = around[: start - max(0, start - AROUND)] + " " + around[len(around) - min(AROUND, len(text) - end) :] if kind == 4 else around
    context = "n" if any(c in cues for c in AGAINST[ALL_KINDS[kind]]) else "y" if any(c in cues for c in CUES[ALL_KINDS[kind]]) else "-"
    shape = "n" if (before.isalnum() or after.isalnum()) else "y" if (not before or before.isspace() or before in "(<\"':=") else "-"
    share, others = len(digits) / len(value), sum(not c.isalnum() for c in value)
    features = (
        "s" if len(value) < 12 else "m" if len(value) < 24 else "l",
        "n" if share < 0.1 else "s" if share < 0.7 else "a",
        "0" if not others else "1" if others < 4 else "4",
        "m" if any(c.islower() for c in value) and any(c.isupper() for c in value) else "-",
        "b" if not before or before.isspace() else "q" if before in "(<\"':=" else "o",
    )
    return f"{kind}{'y' if pattern else 'n'}{check}{known}{context}{shape}{''.join(features)}"


_SPAN = "start:long,kind:int,end:long,code:string"
PARTS_DDL = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<{_SPAN}>>, wider array<struct<{_SPAN}>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("code", pa.string())]))
PARTS = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("base", _SPANS), ("wider", _SPANS)])


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            out = []
            for doc_id, text in zip(batch.column(0).slice(at, 2000).to_pylist(), batch.column(1).slice(at, 2000).to_pylist()):
                text = text or ""
                base = base_spans(text) if "@" in text or _DIGIT.search(text) else []
                counts = [sum(b[1] == k for b in base) for k in range(4)]
                coded = [[{"start": s, "kind": k, "end": e, "code": code(text, (s, k, e), is_base)} for s, k, e in spans] for is_base, spans in ((True, base), (False, wider_spans(text, base)))]
                out.append((doc_id, *counts, hashlib.sha256(as_text(base).encode()).hexdigest(), *coded))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PARTS)], schema=PARTS)


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns of one kind. Returns each pattern's posterior, and (labelers, 2) rates of a right vote by true class."""
    v = np.array([[{"y": 1, "n": 0, "-": -1}[c] for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    said = v >= 0
    p = np.clip((v == 1).sum(1) / np.maximum(1, said.sum(1)), 0.05, 0.95)  # start from the majority
    rates = np.full((v.shape[1], 2), 0.7)
    for _ in range(rounds):
        for j in range(v.shape[1]):
            m = n * said[:, j]
            rates[j, 1] = ((m * p * (v[:, j] == 1)).sum() + 3.5) / ((m * p).sum() + 5)  # prior: 5 votes, 70 % right
            rates[j, 0] = ((m * (1 - p) * (v[:, j] == 0)).sum() + 3.5) / ((m * (1 - p)).sum() + 5)
        prior = np.clip((n * p).sum() / n.sum(), 0.01, 0.99)
        good = np.log(prior) + np.where(said, np.log(np.where(v == 1, rates[:, 1], 1 - rates[:, 1])), 0).sum(1)
        bad = np.log(1 - prior) + np.where(said, np.log(np.where(v == 0, rates[:, 0], 1 - rates[:, 0])), 0).sum(1)
        p = 1 / (1 + np.exp(np.clip(bad - good, -30, 30)))
    return p, rates


def classifier(codes: list[tuple[str, int]]) -> dict[str, float]:
    """codes: (code, count). The span classifier's probability for each code."""
    if not codes:
        return {}
    soft = np.zeros(len(codes))
    for kind in range(len(ALL_KINDS)):
        at = [i for i, (c, _) in enumerate(codes) if c[0] == str(kind)]
        if at:
            soft[at] = reliabilities([(codes[i][0][1:6], codes[i][1]) for i in at])[0]
    columns = sorted({(i, c[i]) for c, _ in codes for i in range(len(c))})
    x = np.array([[1.0, *(float(c[i] == letter) for i, letter in columns)] for c, _ in codes])
    n = np.array([count for _, count in codes], float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (soft - p)) - w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {c: float(q) for (c, _), q in zip(codes, p)}


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """A row per input row: id, counts of base spans by kind, base_sha256, spans (base and added) of the four kinds, and secrets."""
    parts = materialize(docs.select(id_col, text_col).mapInArrow(_propose, PARTS_DDL), "spans")
    codes = parts.select(F.explode(F.concat("base.code", "wider.code")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    sure = {c for c, p in classifier([tuple(r) for r in codes.orderBy("code").collect()]).items() if p >= accept}  # at most MOST_CODES rows
    accepted = docs.sparkSession.sparkContext.broadcast(sure)

    def every(secret: bool):
        @F.arrow_udf("string")
        def joined(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for base, wider in pairs:
                out = []
                for b, w in zip(base.to_pylist(), wider.to_pylist()):
                    spans = [x for x in b if not secret] + [x for x in w if x["code"] in accepted.value and (x["kind"] == SECRET) == secret]
                    out.append(as_text([(x["start"], x["kind"], x["end"]) for x in spans]))
                yield pa.array(out, pa.string())

        return joined("base", "wider")

    return parts.select(F.col("doc_id").alias(id_col), *(f"n_{k}" for k in KINDS), "base_sha256", every(False).alias("spans"), every(True).alias("secrets"))
