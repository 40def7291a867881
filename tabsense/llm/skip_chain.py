"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field then looks at the tokens that hold a digit or an
at sign; all others are fixed to "outside". Neighbouring tokens share a potential, and so
do distant tokens of the same text that repeat or resemble each other (same letters and
digits, same last digits, same name before the at sign). Loopy message passing gives each
token's label; runs of one label that no base span touches are added as spans.

The weights are learned by pseudo-likelihood on a sample of at most TRAIN_DOCS texts. What
the patterns are sure of teaches the labels. To teach the ties, each sure span is written
once more behind its text without its cue (a phone number without its plus, a card number
in dots, a mail address cut at its domain), labelled as the span, and twice with other
digits, labelled outside. So the looks of such a token decide little, and whether
it repeats a sure one decides.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")  # tokens and keys that are named as such; found by the field only
LABELS = ("outside", *KINDS)
TRAIN_DOCS = 2_000
TRAIN_TOKENS = 200  # of one text, for training only
SURE = 0.6  # least probability of an added span
LEAST = {"email": 3, "ip": 4, "card": 12, "phone": 7, "secret": 16}  # letters and digits, for the middle three digits only

# fixed values: the base patterns
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match can only begin where its digits begin
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each at sign, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [(s, e, 0) for s, e in emails(text)]
    small = lambda part: len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= sum(c in string.digits for c in m.group()) <= 15]
    return sorted(out)


SECRET = re.compile(r"""(?i)\b(?:token|secret|api[_-]?key|password)["' ]{0,3}[=:]["' ]{0,3}([A-Za-z0-9_+/-]{16,})""")
CUE = re.compile(r"""(?i)(?:token|secret|api[_-]?key|password)["' ]{0,3}[=:]["' ]{0,3}\Z""")


def secrets(text: str) -> list[Span]:
    """Values that are named as secrets."""
    return [(m.start(1), m.end(1), KINDS.index("secret")) for m in SECRET.finditer(text)]


def sure_spans(text: str) -> list[Span]:
    """What the patterns are sure of: it teaches the labels, and is known when a text is read."""
    return sorted([*base_spans(text), *secrets(text)])


OWN = 30  # features of a token by itself; behind them those by its neighbours
N_FEATURES = OWN + 6
CHUNK = 100_000  # tokens or edges that are worked on at once


class Field:
    """The graph of one text: candidate tokens, their features and the edges between them.

    Held in arrays, some 150 bytes a token, so that a very long text fits; the tokens
    themselves stay in the text.
    """

    def __init__(self, text: str, most: int | None = None) -> None:
        starts, ends, own, sizes, marks = array("q"), array("q"), array("B"), array("B"), array("B")
        keys, holders = array("Q"), array("q")
        for i, (s, e) in enumerate(_tokens(text)):
            token = text[s:e]
            on = _own_features(token, CUE.search(text, max(0, s - 20), s + (token[:1] in "\"'")) is not None)
            starts.append(s)
            ends.append(e)
            own.extend(on)
            sizes.append(len(on))
            marks.append(("+" in token) + 2 * ("(" in token) + 4 * ("-" in token))
            for key in _keys(token):
                keys.append(xxhash.xxh3_64_intdigest(key))
                holders.append(i)
            if most and i + 1 >= most:
                break
        get = lambda a, kind: np.frombuffer(a, kind) if len(a) else np.zeros(0, kind)
        self.starts, self.ends, self.own, self.sizes = get(starts, np.int64), get(ends, np.int64), get(own, np.uint8), get(sizes, np.uint8)
        n = len(self.starts)
        # neighbours: nothing but space characters between them
        self.joined = np.array([b - a < 4 and all(map(_space, text[a:b])) for a, b in zip(ends[:-1], starts[1:])], bool)
        mark, before, after = get(marks, np.uint8), np.r_[False, self.joined][:n], np.r_[self.joined, False][:n]
        left, right = np.r_[np.uint8(0), mark][:n], np.r_[mark[1:], np.uint8(0)][:n]
        self.near = np.stack([before & (left & 1 > 0), before & (left & 2 > 0), before, after & (right & 2 > 0), after & (right & 4 > 0), after], axis=1)
        # each token is tied to the last one before it with the same key, so a token repeated n times has n - 1 ties
        key, holder = get(keys, np.uint64), get(holders, np.int64)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        ties = np.stack([holder[order][:-1][same], holder[order][1:][same]], axis=1)
        ties = np.unique(ties[ties[:, 0] < ties[:, 1]], axis=0)
        ties = ties[~((ties[:, 1] - ties[:, 0] == 1) & np.r_[self.joined, False][ties[:, 0]])] if n else ties
        chain = np.flatnonzero(self.joined)
        self.edges = np.concatenate([np.stack([chain, chain + 1], axis=1), ties]).astype(np.int32)
        self.kinds = np.repeat(np.array([0, 1], np.int8), [len(chain), len(ties)])

    def __len__(self) -> int:
        return len(self.starts)

    def features(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = len(self) if end is None else end
        out = np.zeros((end - start, N_FEATURES), np.float32)
        at = np.r_[0, np.cumsum(self.sizes, dtype=np.int64)]
        out[np.repeat(np.arange(end - start), self.sizes[start:end]), self.own[at[start] : at[end]]] = 1
        out[:, OWN:] = self.near[start:end]
        return out

    def scores(self, unary: np.ndarray) -> np.ndarray:
        parts = [self.features(i, min(i + CHUNK, len(self))) @ unary.astype(np.float32) for i in range(0, len(self), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros((0, unary.shape[1]), np.float32)

    def labels(self, spans: list[Span]) -> np.ndarray:
        """Labels that the spans give to the tokens they touch; of several the first."""
        out = np.zeros(len(self), np.int64)
        for s, e, kind in reversed(spans):
            out[np.searchsorted(self.ends, s, "right") : np.searchsorted(self.starts, e)] = 1 + kind
        return out


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Whitespace tokens that hold a digit or an at sign, in one pass over the text."""
    end, mark = 0, re.compile("[0-9@]")
    while m := mark.search(text, end):
        s, e = m.start(), m.end()
        while s > end and not _space(text[s - 1]):
            s -= 1
        while e < len(text) and not _space(text[e]):
            e += 1
        end = e
        yield s, e


def _space(c: str) -> bool:
    return c == " " or "\t" <= c <= "\r"


def _own_features(token: str, cue: bool) -> list[int]:
    digits = "".join(c for c in token if c in string.digits)
    core = token.strip(string.punctuation)
    parts = core.split(".")
    n = len(digits)
    on = [0, 1 + (0 if n == 0 else 1 if n <= 2 else 2 if n == 3 else 3 if n == 4 else 4 if n <= 8 else 5 if n <= 11 else 6 if n <= 19 else 7)]
    tests = (
        "@" in token, "@" in token and "." in token.rpartition("@")[2].strip("."), token.startswith("+"), "(" in token and ")" in token,
        core.isdecimal(), any(c.isalpha() for c in token), len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 for p in parts),
        "." in core, "-" in core, "=" in token, any(c.isupper() for c in token) and n > 0, 12 <= n <= 19 and luhn(digits), 12 <= n <= 19 and not luhn(digits),
        len(core) > 19, re.fullmatch(r"[0-9]{3}-[0-9]{4}", core) is not None, re.fullmatch(r"[0-9]{4}", core) is not None, len(parts) == 4,
        cue, len(core) >= 16 and core.isalnum() and not core.isdecimal(), len(parts) == 4 and all(len(p) == 4 for p in parts), core.count("-") == 3,
    )
    return on + [9 + i for i, t in enumerate(tests) if t]


def _keys(token: str) -> list[str]:
    core = "".join(c for c in token.lower() if c.isalnum())
    digits = "".join(c for c in token if c in string.digits)
    out = ["core " + core] if len(core) >= 3 else []
    if len(digits) >= 7 and digits == core:
        out.append("digits " + digits[-7:])
    if "@" in token:
        out.append("at " + token.lower().partition("@")[0].lstrip(string.punctuation))
    return out


def without_cue(kind: int, found: str) -> str:
    """A span as it may be written again, such that no base pattern sees it."""
    digits = "".join(c for c in found if c in string.digits)
    if KINDS[kind] == "email":
        name, _, domain = found.partition("@")
        return f"{name}@{domain.partition('.')[0]}"
    if KINDS[kind] == "ip":
        return found.replace(".", "-")
    if KINDS[kind] == "card":
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if KINDS[kind] == "phone":
        area, rest = digits[-10:-7], digits[-7:]
        return (f"{area}{rest}", f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}")[zlib.crc32(found.encode()) % 3]
    return found


_OTHER = str.maketrans(string.digits + "abcdef", "3456789012" + "cdefab")


def lesson(text: str, most: int = TRAIN_TOKENS) -> tuple[Field, np.ndarray]:
    """The field of the beginning of a text with its sure spans written again, and the labels."""
    first = Field(text, most)
    text = text[: first.ends[-1]] if len(first) else ""
    spans = [x for x in sure_spans(text)][:most]
    labels = list(spans)
    for s, e, kind in spans:
        again = without_cue(kind, text[s:e])
        for said in (again, *[again.translate(_OTHER)] * 2):
            text += " and "
            if said is again and not any(a < len(said) and b > 0 for a, b, _ in base_spans(said)):
                labels.append((len(text), len(text) + len(said), kind))
            text += said
    labels += base_spans(text)
    field = Field(text)
    return field, field.labels(sorted(set(labels)))


def train(features: np.ndarray, labels: np.ndarray, edges: np.ndarray, kinds: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Token weights and one potential table per kind of edge, by gradient ascent.

    The aim is the likelihood of each label given its token alone, plus that given the labels
    tied to it as well: token weights that leaned on the ties would be lost without them.
    """
    n, k = len(labels), len(LABELS)
    unary, pair = np.zeros((features.shape[1], k)), np.zeros((2, k, k))
    state = [np.zeros_like(unary), np.zeros_like(unary), np.zeros_like(pair), np.zeros_like(pair)]
    gold = np.eye(k)[labels]
    ends = np.concatenate([edges, edges[:, ::-1]]) if len(edges) else np.empty((0, 2), np.int64)
    both = np.concatenate([kinds, kinds])

    def missing(logits: np.ndarray) -> np.ndarray:
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return (gold - p / p.sum(axis=1, keepdims=True)) / n

    for r in range(1, rounds + 1):
        alone = features @ unary
        tied = alone.copy()
        np.add.at(tied, ends[:, 0], (pair + pair.transpose(0, 2, 1))[both, labels[ends[:, 1]]])
        miss = missing(tied)
        g_unary = features.T @ (missing(alone) + miss) - 2e-4 * unary
        g_pair = np.zeros_like(pair)
        np.add.at(g_pair, (both, labels[ends[:, 1]]), miss[ends[:, 0]])
        g_pair = g_pair - 2e-4 * pair
        for i, (w, g) in enumerate(((unary, g_unary), (pair, g_pair))):
            m, v = state[2 * i], state[2 * i + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w += 0.2 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return unary, pair + pair.transpose(0, 2, 1)


def marginals(field: Field, unary: np.ndarray, table: np.ndarray, known: np.ndarray | None = None, rounds: int = 20) -> np.ndarray:
    """Label probabilities by loopy sum-product message passing, all edges at once, half damped.

    A token with a label above 0 in ``known`` has that label.
    """
    own = field.scores(unary)
    if known is not None and known.any():
        at = np.flatnonzero(known)
        own[at] = -30
        own[at, known[at]] = 0
    own -= own.max(axis=1, keepdims=True)
    if e := len(field.edges):
        source = np.concatenate([field.edges[:, 0], field.edges[:, 1]])
        target = np.concatenate([field.edges[:, 1], field.edges[:, 0]])
        weight = np.exp(np.clip(table, -8, 8)).astype(np.float32)
        kinds = np.concatenate([field.kinds, field.kinds])
        message = np.zeros((2 * e, own.shape[1]), np.float32)

        def total() -> np.ndarray:
            out = own.copy()
            for k in range(own.shape[1]):
                out[:, k] += np.bincount(target, message[:, k], len(own))
            return out

        for _ in range(rounds):
            belief, change = total(), 0.0
            before = message.copy()
            for s in range(0, 2 * e, CHUNK):
                part = slice(s, min(s + CHUNK, 2 * e))
                leaving = belief[source[part]] - before[(np.arange(part.start, part.stop) + e) % (2 * e)]
                leaving = np.exp(leaving - leaving.max(axis=1, keepdims=True))
                new = np.log(np.einsum("ea,eab->eb", leaving, weight[kinds[part]]))
                new -= new.max(axis=1, keepdims=True)
                change = max(change, float(np.abs(new - message[part]).max()))
                message[part] = 0.5 * message[part] + 0.5 * new
            if change < 1e-4:
                break
        own = total()
        own -= own.max(axis=1, keepdims=True)
    p = np.exp(own)
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], weights: tuple[np.ndarray, np.ndarray]) -> list[Span]:
    """Runs of one label that no base span touches, without the punctuation around them."""
    field = Field(text)
    if not len(field):
        return []
    p = marginals(field, *weights, known=field.labels(sorted([*base, *secrets(text)])))
    label = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0)
    label[field.labels(base) > 0] = 0
    out, at = [], -1
    for i in np.flatnonzero(label):
        if i <= at:
            continue
        j = at = int(i)
        while j + 1 < len(label) and label[j + 1] == label[i] and field.joined[j] and "\n" not in text[field.ends[j] : field.starts[j + 1]]:
            j = at = j + 1
        s, e = int(field.starts[i]), int(field.ends[j])
        while s < e and text[s] in string.punctuation and text[s] not in "+(":
            s += 1
        while e > s and text[e - 1] in string.punctuation:
            e -= 1
        kind = KINDS[label[i] - 1]
        held = sum(c in string.digits or (c.isalnum() and kind in ("email", "secret")) for c in text[s:e])
        if held >= LEAST[kind] and (kind != "email" or "@" in text[s:e]):
            out.append((s, e, int(label[i]) - 1))
    return out


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for text in batch["text"].to_pylist():
            field, labels = lesson(text)
            rows.append((np.packbits(field.features().astype(np.uint8)).tobytes(), labels.tolist(), field.edges.ravel().tolist(), field.kinds.tolist()))
        kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["features", "labels", "edges", "kinds"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Weights from the ``most`` texts with a candidate token that have the smallest hashes.

    At most ``most`` * TRAIN_TOKENS tokens and their copies reach the driver, as bits.
    """
    order = F.xxhash64("doc_id", "text")
    fit = texts_of(docs, id_col, text_col).where(F.col("text").rlike("[0-9@]"))
    # texts beyond this share of the hash range cannot be among the smallest, or nearly so, and stay where they are
    share = min(1.0, 1.5 * most / max(fit.count(), 1))
    some = fit.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.pmod(order, F.lit(1 << 30)), "doc_id", "text").limit(most)
    features, labels, edges, kinds, n = [], [], [], [], 0
    for r in some.mapInArrow(_sample, "features binary, labels array<long>, edges array<long>, kinds array<long>").collect():
        count = len(r["labels"])
        bits = np.unpackbits(np.frombuffer(r["features"], np.uint8))[: count * N_FEATURES]
        features.append(bits.reshape(count, N_FEATURES).astype(np.float64))
        labels.append(np.array(r["labels"], np.int64))
        edges.append(np.array(r["edges"], np.int64).reshape(-1, 2) + n)
        kinds.append(np.array(r["kinds"], np.int64))
        n += count
    if not n:
        return np.zeros((N_FEATURES, len(LABELS))), np.zeros((2, len(LABELS), len(LABELS)))
    return train(np.concatenate(features), np.concatenate(labels), np.concatenate(edges), np.concatenate(kinds))


def _find(weights: tuple[np.ndarray, np.ndarray]):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))
        names = ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "n_spans"]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                base = base_spans(text)
                more = added_spans(text, base, weights)
                counts = [sum(k == i for _, _, k in base) for i in range(len(BASE_KINDS))]
                rows.append((doc, *counts, hashlib.sha256(write(base).encode()).hexdigest(), write(base + more), len(base + more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans of every row.

    Counts and the digest are those of the base patterns; spans, as many as n_spans, has them
    and what the field adds.
    A null or empty text has no spans. Repeated rows and null ids give a row each, other columns
    are ignored, an empty table gives none. Without ``weights`` they are learned on ``docs``.
    """
    weights = weights or learn(docs, id_col, text_col)
    return texts_of(docs, id_col, text_col).mapInArrow(_find(weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
