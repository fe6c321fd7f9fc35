r"""Personal data by weak supervision: labelers vote, EM weighs them, a trained classifier decides.

Base rules (e-mail, IP, card, phone) always give spans. Candidates for further spans come from
wider patterns: national numbers without a plus, social-security-like and account-like numbers,
e-mails spelt with "at" and "dot", names after a title. Labelers of three sorts vote on every
candidate, base spans included, or abstain: patterns (a strict form, a checksum), gazetteers
(top-level domains, given names, reserved numbers) and context (words just before and after).

The first pass counts, over all documents, how often each combination of kind, votes and features
occurs; there are a few thousand combinations, however many documents. Expectation-maximisation on
these counts estimates each labeler's reliability and each combination's probability of being
personal (a Dawid-Skene model with a prior per kind). For the classifier a prior counts no less
than a stated belief: else candidates that labelers vote down would take those along on which nearly
all labelers abstain. The second pass labels spans with a logistic
classifier trained on those probabilities; candidates it takes for personal become spans.

Patterns are written to take linear time: an e-mail is found from its ``@`` outwards and runs of
digits are tried from their first digit only, which gives the same matches.

Behaviour at the edges: a null text counts as empty and has no spans; offsets are code points, end
exclusive; base spans of different kinds may overlap and all stay, added ones overlap none; a null
doc_id stays null; repeated rows each have their result; other columns are ignored; an empty table
gives an empty result, and without any candidates nothing is learned and nothing added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("spelt_email", "local_phone", "social", "account", "name")
KINDS = BASE + ADDED
CONTEXT = 48
STEPS, LEAST = 60, 0.6
#: What is believed at least of a candidate that nothing speaks for or against, of the base kinds and of others.
BELIEF, BELIEF_ADDED = 0.9, 0.7
#: Weight of each unseen combination of votes in training, beside a count of one per seen one.
UNSEEN = 0.05

# Gazetteers and context words.
DOMAINS = frozenset("com org net edu gov mil int info biz name io co us uk de fr es it nl eu ch at be pl se no dk fi pt ie ca au nz jp cn in br mx ru za".split())
GIVEN = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen anna maria peter paul hans juan jose pierre marie luis carlos".split())
CUES = {
    "spelt_email": "mail email e-mail contact write reach".split(),
    "local_phone": "phone tel call telephone mobile cell fax contact whatsapp".split(),
    "social": "ssn social security".split(),
    "account": "iban account konto compte cuenta bank".split(),
    "name": "contact name dear sincerely signed author".split(),
    "email": "mail email e-mail contact write reach".split(),
    "ip": "ip address host server login from".split(),
    "card": "card visa mastercard credit karte tarjeta carte".split(),
    "phone": "phone tel call telephone mobile cell fax contact whatsapp".split(),
}
OTHERWISE = frozenset("version page isbn price order item chapter section figure table build".split())

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _NOT_DIGIT, _WORD = re.compile(r"[0-9]"), re.compile(r"[^0-9]"), re.compile(r"[a-z][a-z-]*")
_WIDE = {
    "spelt_email": re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}"),
    "local_phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    "social": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "name": re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30}){0,2}"),
}

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans by start, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def wide_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates of the added kinds that overlap no base span and no candidate of a kind before them."""
    taken, out = joined([(a, b) for _, a, b in base]), []
    some = {"spelt_email": "at" in text and ("[" in text or "(" in text), "name": ". " in text}
    digit = bool(_DIGIT.search(text))
    for name in ADDED:
        if some.get(name, digit):
            free = []
            for m in _WIDE[name].finditer(text):
                # the only span that can overlap is the last that starts before the candidate's end
                k = bisect_left(taken, (m.end(),)) - 1
                if k < 0 or taken[k][1] <= m.start():
                    free.append(m.span())
            out += [(KINDS.index(name), *s) for s in free]
            taken = joined(taken + free)
    return out


def votes(text: str, span: Span) -> tuple[int, ...]:
    """One vote per labeler: 1 personal, 0 not, -1 abstains: form, checksum, gazetteer, before, after."""
    kind, start, end = span
    name, found = KINDS[kind], text[start:end]
    digits = _NOT_DIGIT.sub("", found)
    form, check, listed = -1, -1, -1
    if name in ("email", "spelt_email"):
        form = int(bool(re.search(r"[A-Za-z]", found)) and not found[0] in ".-")
        listed = int(re.split(r"[^A-Za-z]+", found.rstrip(")] "))[-1].lower() in DOMAINS)
    elif name in ("phone", "local_phone"):
        form = int(9 <= len(digits) <= 13)
        listed = 0 if len(set(digits)) < 3 else -1
    elif name == "ip":
        form = int(all(str(int(p)) == p for p in found.split(".")))
        listed = 0 if found.split(".")[0] in ("0", "10", "127", "255") else 1
    elif name == "card":
        form, check, listed = int(len(digits) == 16), int(luhn(digits)), int(digits[0] in "3456")
    elif name == "social":
        # a reserved number is none; that one could be given says little
        form, listed = 1, 0 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else -1
    elif name == "account":
        plain = found.replace(" ", "")
        check = int(int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)
        form = int(15 <= len(plain) <= 34)
    else:
        words = found.split()[1:]
        form, listed = int(len(words) > 1), 1 if words[0].lower() in GIVEN else -1
    cues = CUES[name]
    around = []
    for side in (text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]):
        near = set(_WORD.findall(side.lower()))
        around.append(1 if any(c in near for c in cues) else 0 if near & OTHERWISE else -1)
    return form, check, listed, *around


def features(text: str, span: Span) -> tuple[int, ...]:
    """Buckets of a span's shape: digits, length, separators, capitals."""
    found = text[span[1] : span[2]]
    digits = len(_NOT_DIGIT.sub("", found))
    return min(digits // 4, 5), min((span[2] - span[1]) // 6, 5), int(any(c in found for c in " ()-.")), int(any(c.isupper() for c in found))


Pattern = tuple[int, ...]  # kind, votes, features


def patterns(docs: DataFrame) -> dict[Pattern, int]:
    """How often each combination occurs over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or ""
                base = base_spans(text)
                for span in base + wide_spans(text, base):
                    seen[(span[0], *votes(text, span), *features(text, span))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "pattern array<int>, n long")
    return {tuple(r["pattern"]): r["n"] for r in rows.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}


LABELERS = 5


def probability(keys: np.ndarray, table: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The probability of patterns (rows of kind and votes first) being personal; abstaining tells nothing."""
    each, vote = np.arange(LABELERS), keys[:, 1 : 1 + LABELERS]
    like = [np.where(vote < 0, 0, np.log(table[each, c][each, np.maximum(vote, 0)])).sum(1) for c in (0, 1)]
    odds = like[1] - like[0] + np.log(prior[keys[:, 0]]) - np.log(1 - prior[keys[:, 0]])
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def reliabilities(found: dict[Pattern, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over patterns: (probability of each pattern, P(vote | class) per labeler, prior per kind).

    Each labeler has a distribution over its two votes in either class; they start from a vote
    being right four times in five, the base kinds' prior from their rules having matched.
    """
    keys = list(found)
    votes_of = np.array([k[1 : 1 + LABELERS] for k in keys]).reshape(-1, LABELERS)
    kind, n = np.array([k[0] for k in keys], int), np.array([found[k] for k in keys], float)
    start = np.array([[0.8, 0.2], [0.2, 0.8]])
    table = np.repeat(start[None], LABELERS, 0)  # labeler, class, vote (no, yes)
    prior = np.where(np.arange(len(KINDS)) < len(BASE), 0.9, 0.5)
    codes, p = np.array(keys, int).reshape(len(keys), -1), np.zeros(len(keys))
    for _ in range(STEPS):
        p = probability(codes, table, prior)
        for c, w in ((0, n * (1 - p)), (1, n * p)):
            cast = (w[:, None] * (votes_of >= 0)).sum(0)
            for v in (0, 1):
                table[:, c, v] = ((w[:, None] * (votes_of == v)).sum(0) + 10 * start[c, v]) / (cast + 10)
        for k in range(len(KINDS)):
            own = kind == k
            before = 0.9 if k < len(BASE) else 0.5
            prior[k] = np.clip(((n * p)[own].sum() + 4 * before) / (n[own].sum() + 4), 0.02, 0.98)
    return p, table, prior


def _design(keys: list[Pattern]) -> np.ndarray:
    """Kinds and votes one-hot, feature buckets as numbers."""
    a = np.array(keys, int).reshape(-1, 1 + LABELERS + 4)
    hot = [np.eye(len(KINDS))[a[:, 0]], *(np.eye(3)[a[:, 1 + k] + 1] for k in range(LABELERS)), a[:, 1 + LABELERS :] / 5, np.ones((len(a), 1))]
    return np.concatenate(hot, axis=1)


def train(found: dict[Pattern, int]) -> np.ndarray | None:
    """Weights of the span classifier, fitted to the patterns' EM probabilities by Newton's method.

    Combinations of votes that the corpus lacks count a little, with what EM gives them.
    """
    if not found:
        return None
    keys = list(found)
    _, table, prior = reliabilities(found)
    prior = np.maximum(prior, np.where(np.arange(len(KINDS)) < len(BASE), BELIEF, BELIEF_ADDED))
    grid = [(k, *v, 2, 2, 1, 0) for k in range(len(KINDS)) for v in product((-1, 0, 1), repeat=LABELERS)]
    x, n = _design(keys + grid), np.array([found[k] for k in keys], float)
    p = probability(np.array(keys + grid), table, prior)
    n = np.concatenate([n / n.sum() * len(keys), np.full(len(grid), UNSEEN)])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - q)) - 0.1 * w
        step = np.linalg.solve((x * (n * q * (1 - q) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def spans(text: str, weights: np.ndarray | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, each by kind, then start."""
    base = base_spans(text)
    added = wide_spans(text, base) if weights is not None else []
    if added:
        x = _design([(s[0], *votes(text, s), *features(text, s)) for s in added])
        added = [s for s, z in zip(added, x @ weights) if 1 / (1 + np.exp(-np.clip(z, -30, 30))) >= LEAST]
    return base, sorted(base + added)


def listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base kinds, base_sha256 and spans."""
    weights = train(patterns(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t.as_py() or "", weights) for t in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([listed(x) for _, x in found], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
