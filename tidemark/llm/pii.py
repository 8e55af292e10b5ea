"""Personal data by weak supervision.

Candidate spans come from the contract's four patterns (they stay whatever happens) and from looser ones:
addresses written with "at" and "dot", dotted or bracketed addresses, local telephone numbers, card numbers
with other separators or beside other digits, and a fifth kind, secrets (what is assigned to a token, key or
password, and long runs of letters and digits). Labelers vote on each candidate: gazetteers (top-level domains,
calling codes, issuer prefixes, reserved networks, forms of keys), checks (Luhn, octets, digit counts, entropy),
context words, edges and shape. Counts of vote patterns over all documents, whose number the labelers bound,
feed expectation-maximisation (one reliability for each labeler, class and kind; a labeler that abstains says
nothing); its posteriors train a logistic span classifier over votes and kind. Candidates at 0.5 or more that
overlap no base span and no better candidate are added.

Null and empty texts have no spans; bytes that are no UTF-8 count as replacement characters. Positions are code points, ends exclusive. Repeated rows get the same
spans. A table without candidates adds none. Other columns, whatever their names, play no part.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, materialize, slices

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds that have base spans.
BASE_KINDS = KINDS[:4]
# The contract's patterns. Look-behinds and possessive repeats only keep long runs linear.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser patterns, gazetteers and context words.
LOOSE = {
    "email": re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{2,24}){1,3}\b", re.I),
    "ip": re.compile(r"\b[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?\(dot\) ?|\[dot\])[0-9]{1,3}){3}\b", re.I),
    "card": re.compile(r"\b[0-9]{4}(?:[._/·][0-9]{4}){3}\b|\b[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}\b|(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}\b|(?<![0-9])00[1-9][0-9]{0,2}[ ./-]?[0-9][0-9 ./-]{6,14}[0-9]\b"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_=.~-])[A-Za-z0-9+/_~-]{20,}+={0,2}+(?![A-Za-z0-9+/_=~-])"),
}
ASSIGNED = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|bearer|credentials?)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([^\s\"',;<>]{8,}+)", re.I)
KEY_FORM = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_\w{20,}|github_pat_\w{20,}|sk-\w{16,}|xox[abpr]-[\w-]{10,}|eyJ[\w-]{10,}|AIza[\w-]{30,}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}")
TLDS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn ru br in ch se no fi dk pl at be pt".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92")
ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|65|62|35")
CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "address", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login", "client", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "carte", "tarjeta", "karte"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "ring", "appel", "llame", "anruf", "telefon"),
    "secret": ("token", "secret", "passw", "pwd", "key", "bearer", "credential", "auth"),
}
LABELERS = ("check", "gazetteer", "context", "edges", "shape")
WINDOW = 40


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the contract's spans, in order."""
    out = []
    if "@" in text:
        reach = 0
        for at in (m.start() for m in re.finditer("@", text)):
            if at < reach:
                continue
            start = at  # a match lies within one run of its own characters
            while start > reach and text[start - 1] in _EMAIL_CHARS:
                start -= 1
            if start < at and (m := EMAIL.match(text, start)):
                out.append((m.start(), 0, m.end()))
                reach = m.end()
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := re.sub(r"[\x20-]", "", m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c in _DIGITS for c in m.group()[1:]) <= 15]
    return sorted(out)


_EMAIL_CHARS, _DIGITS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), frozenset("0123456789")


def votes(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """One vote for each labeler: 1 personal data, -1 not, 0 abstains."""
    name, span = KINDS[kind], text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    around = text[max(0, start - WINDOW) : start].lower()
    left, right = text[start - 1 : start], text[end : end + 1]
    if name == "email":
        labels = re.split(r"\s*(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s*", span.lower())
        tld = labels[-1].strip()
        check = 1 if len(labels) > 1 and all(labels) and tld.isalpha() else -1
        gazetteer = 1 if tld in TLDS else -1
        shape = 1 if base or "[" in span or "(" in span or "{" in span else (1 if re.search(r"[0-9._]", span.split()[0]) else -1)
    elif name == "ip":
        parts = [int(x) for x in re.findall(r"[0-9]+", span)[:4]]
        check = 1 if len(parts) == 4 and max(parts) <= 255 else -1
        gazetteer = -1 if parts[0] in (0, 127) or parts[0] >= 224 else 0
        shape = 1 if sum(x > 9 for x in parts) >= 2 else -1
    elif name == "card":
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if ISSUER.match(digits) else -1
        shape = 1 if len(digits) in (15, 16) else 0
    elif name == "secret":
        check = 1 if entropy(span) >= 3.0 else -1
        gazetteer = 1 if KEY_FORM.fullmatch(span) else 0
        shape = 1 if digits and len(digits) < len(span) and not re.search(r"(.)\1{4}", span) else -1
    else:
        check = 1 if 10 <= len(digits) <= 15 else -1
        gazetteer = 1 if (digits.lstrip("0").startswith(CALLING) if span[0] in "+0" else "2" <= digits[0] <= "9") else -1
        shape = 1 if re.search(r"[ ().-]", span) else 0
    context = 1 if any(w in around for w in CONTEXT[name]) else -1 if name == "secret" else 0
    if name == "secret":
        edges = 1 if text[max(0, start - 4) : start].rstrip(" \t\"'")[-1:] in (":", "=") else -1
    else:
        edges = -1 if left.isalnum() or right.isalnum() or left in "#/=_" and left else 1
    return [check, gazetteer, context, edges, shape]


def entropy(span: str) -> float:
    """Bits a character."""
    n = len(span)
    return -sum(c / n * math.log2(c / n) for c in Counter(span).values())


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """All base spans and the looser ones that overlap none of them."""
    starts, ends = [s for s, _, _ in base], [e for _, _, e in base]
    top = list(np.maximum.accumulate(ends)) if ends else []
    out = [(s, k, e, True) for s, k, e in base]
    low = text.lower()
    numbers = [(m.start(), min(len(text), m.end() + 1)) for m in _NUMBERS.finditer(text)]
    for kind, name in enumerate(KINDS):
        if name == "secret":
            found = secrets(text, low)
        elif name in _LOOSE_CHECK:  # within runs of digits and separators, and one sign behind for the edge
            found = [m.span() for s, e in numbers for m in LOOSE[name].finditer(text, s, e) if _LOOSE_CHECK[name](_NOT_DIGIT.sub("", m.group()))]
        else:
            found = [m.span() for m in LOOSE[name].finditer(text)] if any(x in low for x in _HINTS[name]) else []
        for start, end in found:
            at = bisect.bisect_left(starts, end)
            if not (at and top[at - 1] > start):
                out.append((start, kind, end, False))
    return out


def secrets(text: str, low: str) -> list[tuple[int, int]]:
    """What is assigned to a word of the context list, and long runs that mix letters and digits."""
    found = set()
    if max(map(len, text.split()), default=0) >= 20:
        found |= {m.span() for m in LOOSE["secret"].finditer(text) if _ALNUM.search(text, *m.span())}
    if len(low) == len(text) and any(w in low for w in CONTEXT["secret"]):
        found |= {m.span(1) for m in ASSIGNED.finditer(low)}
    elif len(low) != len(text):
        found |= {m.span(1) for m in ASSIGNED.finditer(text)}
    return sorted(found)


_NOT_DIGIT = re.compile(r"[^0-9]")
#: What digits a looser number must have to be a candidate at all.
_LOOSE_CHECK = {"card": luhn, "phone": lambda d: len(d) <= 15}
_ALNUM = re.compile(r"[A-Za-z][^A-Za-z]*[0-9]|[0-9][^0-9]*[A-Za-z]")
_NUMBERS = re.compile(r"[(0-9][0-9 ().\[\]/·_-]{9,}")
#: What a looser address holds in any case.
_HINTS = {"email": ("(dot)", "[dot]", "{dot}", " dot "), "ip": ("[.]", "(.)", "(dot)", "[dot]")}


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base string, and one packed list of candidates for each document; one pass over the texts."""
    rows = docs.select("doc_id", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            count, joined, found = [], [], []
            for raw in as_bytes(batch):
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                count.append([sum(k == i for _, k, _ in base) for i in range(len(BASE_KINDS))])
                joined.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base))
                found.append([{"start": s, "kind": k, "end": e, "base": b, "votes": votes(text, k, s, e, b)} for s, k, e, b in candidates(text, base)])
            per = np.array(count, np.int64).reshape(-1, 4)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(per[:, i]) for i in range(4)], pa.array(joined, pa.string()), pa.array(found, kind)], names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base", "found"])

    return rows.mapInArrow(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<start:bigint,kind:int,end:bigint,base:boolean,votes:array<int>>>")


def fit_reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: P(for | class, a vote) for each labeler, and each pattern's posterior.

    Starts from the majority vote. Abstentions are missing: they neither count nor weigh. Prior counts (two of
    three votes right) keep rare votes finite and the classes' names in place.
    """
    post = 1 / (1 + np.exp(-patterns.sum(1).astype(float)))
    likely = np.zeros((patterns.shape[1], 2))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        yes, no = weight @ (patterns == 1), weight @ (patterns == -1)
        likely = ((yes + [[1.0], [2.0]]) / (yes + no + 3.0)).T
        prior = (weight.sum(1) + 1.0) / (counts.sum() + 2.0)
        log = np.log(prior)[:, None] + np.log(likely).T @ (patterns == 1).T + np.log(1 - likely).T @ (patterns == -1).T
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return likely, post


def features(patterns: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Bias, votes for and against, and the kind."""
    return np.hstack([np.ones((len(patterns), 1)), patterns == 1, patterns == -1, kinds[:, None] == np.arange(len(KINDS))]).astype(float)


def fit_classifier(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def train(found: DataFrame) -> np.ndarray:
    """The span classifier. What comes to the driver is a count for each pattern of votes: 5 x 3^5 rows at most."""
    each = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes").count().orderBy("kind", "votes").collect()
    if not each:
        return np.zeros(1 + 2 * len(LABELERS) + len(KINDS)) - 1.0
    kinds, patterns, counts = np.array([r["kind"] for r in each]), np.array([r["votes"] for r in each]), np.array([r["count"] for r in each], float)
    post = np.zeros(len(each))
    for k in set(kinds.tolist()):
        own = kinds == k
        _, post[own] = fit_reliabilities(patterns[own], counts[own])
    return fit_classifier(features(patterns, kinds), post, counts / counts.sum() * min(counts.sum(), 1e6))


def find_personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added, n_secret, n_spans."""
    found = materialize(find_candidates(docs), "pii")
    weights = train(found).tolist()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for batch in batches:
            spans, added, sha, secret, every = [], [], [], [], []
            for base, own in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                sha.append(hashlib.sha256(base.encode()).hexdigest())
                kept = [(c["start"], c["kind"], c["end"]) for c in own if c["base"]]
                if more := [c for c in own if not c["base"]]:
                    score = features(np.array([c["votes"] for c in more]), np.array([c["kind"] for c in more])) @ w
                    taken: list[tuple[int, int]] = []
                    for i in np.argsort(-score, kind="stable"):
                        c = more[i]
                        at = bisect.bisect_left(taken, (c["end"], -1))
                        if score[i] >= 0 and not (at and taken[at - 1][1] > c["start"]):
                            taken.insert(at, (c["start"], c["end"]))
                            kept.append((c["start"], c["kind"], c["end"]))
                added.append(len(kept) - sum(c["base"] for c in own))
                secret.append(sum(KINDS[k] == "secret" for _, k, _ in kept))
                every.append(len(kept))
                spans.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(kept)))
            own = [pa.array(sha, pa.string()), pa.array(spans, pa.string()), *[pa.array(x, pa.int64()) for x in (added, secret, every)]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *own], names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "n_added", "n_secret", "n_spans"])

    return found.mapInArrow(finish, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_spans long")
