"""Personal data by weak supervision.

Regular expressions propose spans; labelers (validity, shape, context, gazetteer) each vote for, against or
abstain. Spans with one vote pattern behave alike, so counting patterns over the whole corpus is all that
training needs: expectation-maximisation over the counts estimates each labeler's reliability without labels,
and a logistic span classifier is fitted to the resulting posteriors. Spans that the classifier accepts are
added to the base ones, which always stay.

Defined cases: a null or empty text has no spans. Repeated rows are judged row by row. An empty table gives an
empty result; other columns are ignored. Texts are read whole, and a span has no longest length. Spans are in code
points, their end exclusive. Base spans of different kinds may overlap and all stay; a further proposal that touches
a base span or an earlier proposal is left out. When spans are masked, the one that begins first names the mask, of
equal begins the shorter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.common import id_text, materialize, table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LABELERS = ("valid", "shape", "context", "gazetteer")
NO, ABSTAIN, YES = 0, 1, 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Proposals beyond the base patterns.
_AT = re.compile(r" ?[(\[]at[)\]] ?")
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]+)+")
_LOCAL_PHONE = re.compile(r"(?<![0-9.+-])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])")
_ONE_CARD = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
_SECRET = re.compile(r"(?:password|passwd|secret|token|api_key) ?= ?\"?[^\s\"]{6,}|\bAKIA[0-9A-Z]{16}\b")

#: The words each labeler knows.
CONTEXT = {
    "email": re.compile(r"(?i)mail|contact|write|reach|kontakt|correo|courriel"),
    "ip": re.compile(r"(?i)\bip\b|host|server|address|client|login|adresse"),
    "card": re.compile(r"(?i)card|visa|master|payment|kart|tarjeta|carte"),
    "phone": re.compile(r"(?i)phone|\btel\b|call|mobile|fax|anruf|appel"),
    "secret": re.compile(r"(?i)key|login|access|secret|user|pass"),
}
AGAINST = re.compile(r"(?i)version|isbn|issn|order|invoice|\bv\.? ?$|section|chapter|figure")
TLDS = frozenset("com org net edu gov info io de fr es uk eu ch at it nl us ca".split())
DIAL_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 81 82 86 90 91".split())
CARD_STARTS = {13: ("4",), 14: ("30", "36", "38"), 15: ("34", "37")}  # by digits; the longer begin with 3 to 6


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        value = ord(d) - 48
        if n % 2:
            value = 2 * value - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each holds one @ right after its local part, so the @s drive the search."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with (at) and (dot), found from their sign outwards, so a long one costs no more than its length."""
    last = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _SPELLED_DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain:
            last = domain.end()
            yield start, last


def _ip_valid(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind, without those that fail its condition."""
    return {k: [(s, e) for s, e, ok in v if ok] for k, v in _matches(text).items()}


def _matches(text: str) -> dict[str, list[tuple[int, int, bool]]]:
    out: dict[str, list[tuple[int, int, bool]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = [(s, e, True) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out["ip"] = [(*m.span(), _ip_valid(m[0])) for m in _IP.finditer(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) >= 13:
                out["card"].append((*m.span(), 16 <= len(digits) <= 19 and luhn(digits)))
        if "+" in text:
            for m in _PHONE.finditer(text):
                out["phone"].append((*m.span(), 8 <= sum(c.isdigit() for c in m[0]) <= 15))
    return out


def _votes(kind: str, text: str, start: int, end: int, valid: bool | None) -> tuple[int, ...]:
    """Each labeler's vote; ``valid`` is None where nothing in the span can be checked."""
    found = text[start:end]
    before = text[max(0, start - 40) : start]
    around = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    context = NO if AGAINST.search(before) else YES if CONTEXT[kind].search(before) else ABSTAIN
    if kind == "email":
        known = YES if found.rsplit(".", 1)[-1].lower() in TLDS else ABSTAIN
    elif kind == "phone":
        known = YES if any(found[1 : 1 + n] in DIAL_CODES for n in (1, 2)) else ABSTAIN
    elif kind == "card":
        digits = "".join(c for c in found if c.isdigit())
        valid = len(digits) <= 19 and luhn(digits)
        known = YES if digits.startswith(CARD_STARTS.get(len(digits), ("3", "4", "5", "6"))) else NO
    elif kind == "ip":
        known = NO if found.startswith(("0.", "127.", "255.")) else ABSTAIN
    else:
        known = YES if any(c.isdigit() for c in found) else NO
    return (ABSTAIN if valid is None else YES if valid else NO, YES if around else NO, context, known)


def pattern_code(kind: str, votes: Sequence[int]) -> int:
    code = KINDS.index(kind)
    for v in votes:
        code = 3 * code + v
    return code


def decode_pattern(code: int) -> tuple[int, list[int]]:
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v)
    return code, votes[::-1]


def propose(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, int, int, bool]]]:
    """Base spans by kind, and all proposals as (kind, start, end, vote pattern, whether base)."""
    matches = _matches(text)
    base = {k: [(s, e) for s, e, ok in v if ok] for k, v in matches.items()}
    out = [
        (KINDS.index(k), s, e, pattern_code(k, _votes(k, text, s, e, ok)), ok) for k, v in matches.items() for s, e, ok in v
    ]
    taken = sorted((s, e) for v in base.values() for s, e in v)

    def more(kind: str, found: Iterator[tuple[int, int]], valid: bool | None) -> None:
        nonlocal taken
        new: list[tuple[int, int]] = []
        reach, n = 0, 0  # where the taken spans that begin before this one end
        for s, e in found:
            while n < len(taken) and taken[n][0] < e:
                reach = max(reach, taken[n][1])
                n += 1
            if reach <= s:
                new.append((s, e))
                out.append((KINDS.index(kind), s, e, pattern_code(kind, _votes(kind, text, s, e, valid)), False))
        taken = sorted(taken + new)

    # a number that its neighbours' digits were read into
    misread = [(s, e) for s, e, ok in matches["card"] if not ok]
    more("card", (m.span() for s, e in misread for m in _ONE_CARD.finditer(text, s, e) if luhn(m[0])), True)
    if "at)" in text or "at]" in text:
        more("email", _spelled(text), None)
    if _DIGIT.search(text):
        more("phone", (m.span() for m in _LOCAL_PHONE.finditer(text)), None)
    if "=" in text or "AKIA" in text:
        more("secret", (m.span() for m in _SECRET.finditer(text)), None)
    return base, out


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of each vote pattern by expectation-maximisation.

    Each kind has a prior, each labeler of each kind a distribution of votes given the truth. Starting from
    the majority of votes, the rounds alternate expected truths and smoothed reliabilities.
    """
    kinds, votes = zip(*(decode_pattern(int(c)) for c in codes)) if len(codes) else ((), ())
    kind, vote = np.array(kinds, int), np.array(votes, int).reshape(len(codes), len(LABELERS))
    weight = counts.astype(float)
    posterior = np.clip(0.5 + 0.2 * (vote - 1).sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        logs = np.zeros((len(codes), 2))
        for k in set(kinds):
            own = kind == k
            truth = np.stack([1 - posterior[own], posterior[own]], axis=1) * weight[own, None]
            prior = truth.sum(axis=0) + 1
            logs[own] += np.log(prior / prior.sum())
            for j in range(len(LABELERS)):
                table_ = np.stack([np.bincount(vote[own, j], truth[:, y], 3) for y in (0, 1)])
                table_ += np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]])  # labelers are better than chance
                table_ /= table_.sum(axis=1, keepdims=True)
                logs[own] += np.log(table_[:, vote[own, j]]).T
        posterior = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -40, 40)))
    return posterior


def _features(codes: np.ndarray) -> np.ndarray:
    rows = np.zeros((len(codes), len(KINDS) + 2 * len(LABELERS)))
    for n, c in enumerate(codes):
        kind, votes = decode_pattern(int(c))
        rows[n, kind] = 1
        for j, v in enumerate(votes):
            rows[n, len(KINDS) + 2 * j] = v == YES
            rows[n, len(KINDS) + 2 * j + 1] = v == NO
    return rows


def train(codes: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of the span classifier: logistic regression on the posteriors, by Newton steps."""
    x, y = _features(codes), estimate(codes, counts)
    weight = np.sqrt(counts.astype(float))  # a frequent pattern does not drown the others
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - 0.1 * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        beta += np.linalg.solve(hessian, gradient)
    return beta


def accepted(beta: np.ndarray) -> frozenset[int]:
    """The vote patterns that the classifier takes for personal data; there are few enough to list them all.

    A span that its own check digits, ranges or length contradict is not one, whatever the other votes.
    """
    codes = np.arange(len(KINDS) * 3 ** len(LABELERS))
    good = codes[_features(codes) @ beta >= 0].tolist()
    return frozenset(c for c in good if decode_pattern(c)[1][0] != NO)


_PROPOSALS = "array<struct<kind:int,start:int,end:int,code:int,base:boolean>>"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32()), ("base", pa.bool_())])
    )
    names = ("kind", "start", "end", "code", "base")
    for batch in batches:
        found, shown = [], []
        counts: list[list[int]] = [[], [], [], []]
        for text in batch.column(1):
            base, spans = propose(text.as_py())
            for n, k in enumerate(BASE_KINDS):
                counts[n].append(len(base[k]))
            listed = ",".join(f"{k}:{s}:{e}" for k in BASE_KINDS for s, e in base[k])
            shown.append(hashlib.sha256(listed.encode()).hexdigest())
            found.append([dict(zip(names, s)) for s in spans])
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shown, pa.string()), pa.array(found, kind)]
        yield pa.RecordBatch.from_arrays(
            columns, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"]
        )


def detect(docs: DataFrame) -> DataFrame:
    """Per document the base counts and digest, and ``found``: the final spans with their kinds.

    One pass over the texts records proposals; their vote patterns, a few hundred at most, are counted over the
    whole corpus and brought to the driver to train; the second pass reads the recorded proposals alone.
    """
    schema = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found {_PROPOSALS}"
    proposals = materialize(id_text(docs).mapInArrow(_propose, schema), "pii-proposals")
    counted = proposals.select(F.explode("found.code").alias("code")).groupBy("code").count().collect()
    rows = sorted((r["code"], r["count"]) for r in counted)
    codes, counts = np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], float)
    good = accepted(train(codes, counts)) if rows else frozenset()
    kept = F.filter("found", lambda x: x["base"] | x["code"].isin(*good) if good else x["base"])
    return proposals.withColumn(
        "found", F.array_sort(F.transform(kept, lambda x: F.struct(x["kind"], x["start"], x["end"])))
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars`` follows, other columns stay.

    The texts are read twice: once to train, once to mask with what was learned, so no text is shuffled.
    """
    return docs.mapInArrow(_Redactor(accepted_of(docs), docs.columns), docs.schema)


def accepted_of(docs: DataFrame) -> frozenset[int]:
    """Train on ``docs`` and list the accepted vote patterns."""
    schema = "code int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(1):
                for span in propose(text.as_py())[1]:
                    total[span[3]] = total.get(span[3], 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["code", "n"]
        )

    counted = id_text(docs).mapInArrow(run, schema).groupBy("code").agg(F.sum("n").alias("n")).collect()
    rows = sorted((r["code"], r["n"]) for r in counted)
    return accepted(train(np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], float))) if rows else frozenset()


class _Redactor:
    """Masks the spans of each text with the trained patterns."""

    def __init__(self, good: frozenset[int], columns: Sequence[str]):
        self.good, self.columns = good, list(columns)

    def mask(self, text: str | None) -> str | None:
        if text is None:
            return None
        spans = sorted((s, e, k) for k, s, e, code, base in propose(text)[1] if base or code in self.good)
        if not spans:
            return text
        out, last = [], 0
        for start, end, kind in spans:
            if start >= last:
                out += [text[last:start], f"[{KINDS[kind].upper()}]"]
            last = max(last, end)
        return "".join([*out, text[last:]])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            at = self.columns.index("text")
            masked = [self.mask(t) for t in columns[at].to_pylist()]
            columns[at] = pa.array(masked, columns[at].type)
            if "n_chars" in self.columns:
                n = self.columns.index("n_chars")
                columns[n] = pa.array([None if t is None else len(t) for t in masked], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    shown = F.transform(
        "found", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    )
    return detect(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(shown, ",").alias("spans")
    )
