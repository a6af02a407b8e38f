"""Personal data: pattern kinds plus a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import common

KINDS = ("email", "ip", "card", "phone")
#: O, then B and I of each kind.
LABELS = 1 + 2 * len(KINDS)
#: Documents and word windows that the training table is made of, the smallest hashes first; of a window, the words that train.
FIT_DOCS, FIT_WINDOWS, FIT_WORDS = 4_000, 6_000, 32
#: Lines of labelled() that train beside them.
FIT_LINES = 1_500
#: Words of a run at most; a longer one, such as a table of numbers, goes on in the next run, which repeats its last words.
RUN, AGAIN = 4096, 16
#: Words that are scored and decoded at a time.
BATCH_WORDS = 40_000
BUCKETS = 1 << 13
#: The least mean marginal probability of a span that the field adds, and how many digits and characters one of its kind may have.
SURE = 0.9
DIGITS = ((0, 64), (1, 39), (12, 19), (7, 15))
LONGEST = 254

# Fixed values of the contract, written so that each runs in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT = re.compile("@")
DIGIT = re.compile("[0-9]")
#: A digit, an at sign, or the word `at` before a dotted word.
TRIGGER = re.compile(r"[0-9@a](?:(?<!a)|(?<![^\x20\x09-\x0D]a)t(?=[\x20\x09-\x0D]+[^\x20\x09-\x0D]*[A-Za-z0-9-]\.[A-Za-z]))")
#: Words of more characters are cut at punctuation, and pieces that are still longer after so many.
LONG = 64
PIECE = re.compile(r"""[^,;:|"'{}\[\]=&<>]+""")
#: Forms that the patterns miss: where one stands unlabelled, nobody knows whether it is personal data.
UNKNOWN = re.compile(
    r"[A-Za-z0-9._%+-]@[A-Za-z0-9]|[A-Za-z0-9]\x20at\x20[A-Za-z0-9-]+\.[A-Za-z]|(?<![0-9])\(?[0-9]{3,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
    r"|[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}|(?<![0-9])00[1-9][0-9][\x20-]|[0-9a-f]{1,4}:[0-9a-f]{0,4}:[0-9a-f]"
)
GAP = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = frozenset(" \t\n\x0b\x0c\r")

Span = tuple[int, int, int]  # kind, start, stop

#: Rules of the labelled table: what drawn() fills in, a span in braces behind its kind. The first are personal data that the
#: patterns miss, the others numbers and addresses that are none.
FORMS = (
    "phone{(###) ###-####}", "phone{###-###-####}", "phone{###.###.####}", "phone{### ### ####}", "phone{(0##) ### ####}", "phone{1-###-###-####}", "phone{00## ## #### ####}", "phone{0##-#######}",
    "email{<name>.<name> at <host>.<top>}", "email{<name> at <host>.<top>}", "email{<name>@localhost}", "email{<name>.<name>@<host>}", "email{<name> at lists.<host>.<top>}", "email{<name>_<name> at mail.<host>.<top>}", "email{root@<host>}",
    "card{<card>.<card>.<card>.<card>}", "card{<card>/<card>/<card>/<card>}", "card{<card>_<card>_<card>_<card>}",
    "ip{<hex>:<hex>:0:<hex>::#}", "ip{fe80::<hex>:<hex>:<hex>:<hex>}", "ip{2001:db8::<hex>:####}",
)
PLAIN = (
    "1###-1###", "##/##/20##", "20##-0#-1#", "1#:##", "978-#-##-######-#", "#,###,###", "##.##", "#.#.#", "v#.##.###", "########", "##-##", "### ###", "look at <host>.<top>", "met at noon", "<host>.<top>", "# @ ##", "@<name>", "page ##",
    "1## km", "$##.##", "##%", "#### <word>", "No. ###/##", "####-##-##T##:##", "room ###", "at ##.## today", "<word> ##", "Q#/20##", "## <word> ## <word>", "#### #### ####", "####-#### ####",
    "## ## ## ## ## ##", "# # # # # # #", "### ## ### ## ### ##", "##, ##, ##, ##", "#### ### ## # ## ###", "## ## ## ## ## ## ## ## ## ## ## ##", "##.# ##.# ##.# ##.#",
)
CARRIERS = (
    "call", "phone", "tel", "or ring", "fax", "text", "dial", "reach us on", "mail", "write to", "ask", "contact", "from", "or", "for", "number", "host", "server", "card", "paid with", "account", "see", "in", "about", "the", "order",
    "version", "by", "between", "section", "was", "is", "costs", "since", "on", "and", "with", "id", "ref",
)
NAMES = ("jane", "doe", "ann", "lee", "max", "poe", "kim", "oh", "ray", "fox", "li", "sam", "ivy", "hart", "joe", "low", "mia", "berg", "tom", "day")
HOSTS = ("example", "mail", "host", "intranet", "server", "web", "site", "office", "shop", "lab")
MARKED = re.compile(r"(email|ip|card|phone)\{([^}]*)\}")


BLANK = re.compile(r"#|<(\w+)>")


def drawn(form: str, rnd: np.random.Generator) -> str:
    """form with a digit for each #, and names, hosts, domains, words, hexadecimal digits and a card number's for the rest."""
    first = "".join(map(str, rnd.integers(0, 10, 15)))
    card = first + next(d for d in "0123456789" if luhn(first + d))
    groups = iter([card[k : k + 4] for k in range(0, 16, 4)])
    pick = lambda values: values[int(rnd.integers(len(values)))]
    held = {"name": NAMES, "host": HOSTS, "top": ("com", "org", "net", "de"), "word": CARRIERS}

    def fill(m: re.Match) -> str:
        if m[0] == "#":
            return str(rnd.integers(10))
        if m[1] == "card":
            return next(groups)
        return "".join(pick("0123456789abcdef") for _ in range(4)) if m[1] == "hex" else pick(held[m[1]])

    return BLANK.sub(fill, form)


def labelled(lines: int = FIT_LINES, seed: int = 1) -> list[tuple[str, list[Span]]]:
    """Texts of a few words around a drawn form, and their spans; two in five hold none. The same for the same seed."""
    rnd = np.random.default_rng(seed)
    out = []
    for _ in range(lines):
        kinds = PLAIN if rnd.random() < 0.4 else FORMS
        words = [CARRIERS[int(k)] for k in rnd.integers(len(CARRIERS), size=int(rnd.integers(2, 7)))]
        at = int(rnd.integers(1, len(words) + 1))
        form = drawn(kinds[int(rnd.integers(len(kinds)))], rnd) + ("", "", "", ".", ",")[int(rnd.integers(5))]
        line, spans, plain, last = " ".join([*words[:at], form, *words[at:]]), [], "", 0
        for m in MARKED.finditer(line):
            plain += line[last : m.start()]
            spans.append((KINDS.index(m[1]), len(plain), len(plain) + len(m[2])))
            plain, last = plain + m[2], m.end()
        out.append((plain + line[last:], spans))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(t: str) -> list[Span]:
    """The spans of the four patterns, leftmost and non-overlapping within a kind, by kind, then start."""
    out: list[Span] = []
    last = 0
    for m in AT.finditer(t):
        i = m.start()
        while i > last and t[i - 1] in LOCAL:
            i -= 1
        if i < m.start() and (d := DOMAIN.match(t, m.end())):
            out.append((0, i, d.end()))
            last = d.end()
    if DIGIT.search(t):
        for m in IP.finditer(t):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                out.append((1, m.start(), m.end()))
        for m in CARD.finditer(t):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 16 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in t:
            for m in PHONE.finditer(t):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def _triggers(t: str, a: int, b: int) -> bool:
    """Whether a trigger begins in t[a:b]; it may look at what follows."""
    hit = TRIGGER.search(t, a)
    return hit is not None and hit.start() < b


def windows(t: str, around: int = 2) -> Iterator[list[tuple[int, int]]]:
    """Runs of words, as offsets, that hold a trigger or are among the `around` words beside one that does.

    Spans lie within these runs, so the rest of the text, though all of it is searched, needs no labels. A run of RUN words ends,
    and the next repeats its last AGAIN words.
    """
    at, size, run, ahead = 0, len(t), [], 0
    while at < size:
        hit = TRIGGER.search(t, at)
        if not hit:
            break
        begin = hit.start()
        while begin > at and t[begin - 1] not in SPACES:
            begin -= 1
        before: list[tuple[int, int]] = []
        i = begin
        while len(before) < around and i > at:
            while i > at and t[i - 1] in SPACES:
                i -= 1
            j = i
            while i > at and t[i - 1] not in SPACES:
                i -= 1
            if i < j:
                before.append((i, j))
        if run and len(before) == around:  # words may lie between this run and the last
            yield run
            run = []
        run += before[::-1]
        if len(run) >= RUN:
            yield run
            run = run[-AGAIN:]
        gap = GAP.search(t, hit.end())
        run.append((begin, gap.start() if gap else size))
        at, ahead = run[-1][1], around
        while ahead:
            m = WORD.search(t, at)
            if not m or _triggers(t, m.start(), m.end()):
                break
            run.append(m.span())
            at, ahead = m.end(), ahead - 1
    if run:
        yield run


def tokens(t: str, around: int = 2) -> Iterator[list[tuple[int, int]]]:
    """The runs of windows(), long words cut into pieces; of these, only those that hold a trigger or are near one."""
    for run in windows(t, around):
        if all(b - a <= LONG for a, b in run):
            yield run
            continue
        pieces = [(p, min(p + LONG, m.end())) for a, b in run for m in (PIECE.finditer(t, a, b) if b - a > LONG else (WORD.match(t, a),)) for p in range(m.start(), m.end(), LONG)]
        hits = [k for k, (a, b) in enumerate(pieces) if TRIGGER.search(t, a, b) or t[a:b] == "at" and _triggers(t, a, b)]
        near, last = [], -1
        for k in hits:
            if near and k - around > last + 1:
                yield near
                near = []
            near += pieces[max(last + 1, k - around) : k + around + 1]
            last = max(last, min(k + around, len(pieces) - 1))
        if near:
            yield near


@lru_cache(maxsize=1 << 16)
def _shape(word: str) -> tuple[str, ...]:
    digits = sum(c.isdigit() for c in word)
    marks = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    short = re.sub(r"(.)\1+", r"\1", marks)
    plain = word.strip(".,;:|\"'()<>[]")
    checked = plain.isascii() and plain.isdigit() and 16 <= len(plain) <= 19 and luhn(plain)
    return (f"s{short[:24]}", f"d{min(digits, 20)}", f"n{min(len(word), 24)}", f"h{word[0] if not word[0].isalnum() else 'x'}", f"@{'@' in word}", f".{min(word.count('.'), 4)}", f"l{checked}", f"={word == 'at'}")


def codes(t: str, run: list[tuple[int, int]]) -> np.ndarray:
    """Feature numbers (words x features): a word's shape features, and of its neighbours the collapsed shapes and whether they
    are the word at."""
    shapes = [_shape(t[a:b]) for a, b in run]
    edge = ("<>",)
    rows = []
    for i, s in enumerate(shapes):
        before, after = (shapes[i - 1] if i else edge), (shapes[i + 1] if i + 1 < len(shapes) else edge)
        rows.append([zlib.crc32(f.encode()) % BUCKETS for f in (*s, s[0] + s[1], "p" + before[0], "q" + after[0], "p" + before[-1], "q" + after[-1], "1")])
    return np.array(rows, np.int32)


def tags(run: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """The label of each word of run: B or I of the first span that it touches."""
    out, last = [], None
    for a, b in run:
        hit = next((s for s in spans if s[1] < b and s[2] > a), None)
        out.append(0 if hit is None else 1 + 2 * hit[0] + (hit == last))
        last = hit
    return out


def examples(lines: int = FIT_LINES) -> list[tuple[np.ndarray, list[int]]]:
    """The rows of labelled() as feature numbers and labels."""
    return [(codes(t, w), tags(w, spans)) for t, spans in labelled(lines) for w in tokens(t)]


def _padded(items: list[np.ndarray], fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in items])
    out = np.full((len(items), sizes.max(), *items[0].shape[1:]), fill, np.int64)
    for i, x in enumerate(items):
        out[i, : len(x)] = x
    return out, sizes


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Field:
    """emit: feature x label; step: label x label; begin: label."""

    emit: np.ndarray
    step: np.ndarray
    begin: np.ndarray

    @staticmethod
    def empty() -> Field:
        return Field(np.zeros((BUCKETS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS))

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((*x.shape[:2], LABELS))
        for k in range(x.shape[2]):  # one feature at a time: words x labels, not words x features x labels
            out += self.emit[x[:, :, k]]
        return out

    def forward_backward(self, s: np.ndarray, sizes: np.ndarray):
        """Marginals of labels, summed marginals of label pairs, for padded sequences."""
        n, most, _ = s.shape
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0] + self.begin
        for t in range(1, most):
            alpha[:, t] = _lse(alpha[:, t - 1, :, None] + self.step, 1) + s[:, t]
        for t in range(most - 2, -1, -1):
            on = (t + 1 < sizes)[:, None]
            beta[:, t] = np.where(on, _lse(self.step + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0.0)
        z = _lse(alpha[np.arange(n), sizes - 1], 1)
        real = np.arange(most) < sizes[:, None]
        marginal = np.exp(np.where(real[..., None], alpha + beta - z[:, None, None], -np.inf))
        pairs = np.zeros((LABELS, LABELS))
        for t in range(1, most):
            on = t < sizes
            if on.any():
                p = alpha[on, t - 1, :, None] + self.step + (s[on, t] + beta[on, t])[:, None, :] - z[on, None, None]
                pairs += np.exp(p).sum(axis=0)
        return marginal, pairs

    def viterbi(self, s: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        n, most, _ = s.shape
        best, back = s[:, 0] + self.begin, np.zeros(s.shape, np.int8)
        ends = np.zeros(n, np.int64)
        for t in range(most):
            if t:
                through = best[:, :, None] + self.step
                back[:, t] = through.argmax(axis=1)
                best = through.max(axis=1) + s[:, t]
            over = sizes == t + 1
            ends[over] = best[over].argmax(axis=1)
        out = []
        for i, k in enumerate(sizes):
            path = np.zeros(k, np.int64)
            path[-1] = ends[i]
            for t in range(k - 1, 0, -1):
                path[t - 1] = back[i, t, path[t]]
            out.append(path)
        return out


def train(table: list[tuple[np.ndarray, list[int]]], epochs: int = 30, rate: float = 0.3, penalty: float = 1e-4, batch: int = 256) -> Field:
    """Maximum likelihood by AdaGrad over batches in a fixed order. An empty table gives a field that labels nothing."""
    field = Field.empty()
    if not table:
        field.begin[1:] = field.step[:, 1:] = -50.0
        return field
    params = (field.emit, field.step, field.begin)
    seen = [np.full_like(p, 1e-6) for p in params]
    order = np.random.default_rng(0)
    for _ in range(epochs):
        index = order.permutation(len(table))
        for a in range(0, len(index), batch):
            chosen = [table[i] for i in index[a : a + batch]]
            x, sizes = _padded([c for c, _ in chosen])
            y, _ = _padded([np.array(t) for _, t in chosen])
            marginal, pairs = field.forward_backward(field.scores(x), sizes)
            real = np.arange(x.shape[1]) < sizes[:, None]
            gap = (np.eye(LABELS)[y] - marginal) * real[..., None]
            grads = [np.zeros_like(p) for p in params]
            np.add.at(grads[0], x[real], gap[real][:, None, :])
            follows = real[:, 1:]
            np.add.at(grads[1], (y[:, :-1][follows], y[:, 1:][follows]), 1.0)
            grads[1] -= pairs
            grads[2] += gap[:, 0].sum(axis=0)
            for p, g, s in zip(params, grads, seen, strict=True):
                g = g / len(chosen) - penalty * p
                s += g * g
                p += rate * g / np.sqrt(s)
    return field


def training_table(docs: DataFrame, docs_bound: int = FIT_DOCS, windows_bound: int = FIT_WINDOWS) -> list[tuple[np.ndarray, list[int]]]:
    """Word windows of a bounded sample of documents, labelled by the patterns, ordered by a hash of doc_id, and examples().

    At most docs_bound documents, windows_bound windows and FIT_WORDS words of each. Windows that hold an UNKNOWN form beside the
    spans of the patterns are left out: they are no proof of either.
    """
    some = docs.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(docs_bound)

    def run(batches):
        for b in batches:
            rows = []
            for h, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = raw.decode("utf-8", "replace")
                spans = base_spans(t)
                for place, w in enumerate(tokens(t)):
                    w = w[:FIT_WORDS]
                    if not w or any(not any(x < m.end() and y > m.start() for _, x, y in spans) for m in UNKNOWN.finditer(t, w[0][0], w[-1][1])):
                        continue
                    rows.append({"h": h, "place": place, "codes": codes(t, w).ravel().tolist(), "tags": tags(w, spans)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("h", pa.int64()), ("place", pa.int32()), ("codes", pa.list_(pa.int32())), ("tags", pa.list_(pa.int32()))]))

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("_text")).join(F.broadcast(some), "doc_id").select("_h", "_text")
    found = texts.mapInArrow(run, "h long, place int, codes array<int>, tags array<int>").orderBy("h", "place", "codes").limit(windows_bound).collect()
    return [(np.array(r["codes"], np.int32).reshape(len(r["tags"]), -1), r["tags"]) for r in found] + examples()


def _trimmed(t: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not (t[a].isalnum() or t[a] in "+("):
        a += 1
    while b > a and not t[b - 1].isalnum():
        b -= 1
    return a, b


def _decoded(field: Field, group: list[tuple[int, list[tuple[int, int]]]], texts: list[str]) -> Iterator[tuple[int, Span]]:
    """Text and span of what the field is sure of in a group of runs, which are padded to the longest."""
    x, sizes = _padded([codes(texts[i], w) for i, w in group])
    s = field.scores(x)
    paths = field.viterbi(s, sizes)
    if not any(p.any() for p in paths):
        return
    marginal, _ = field.forward_backward(s, sizes)
    for k, ((i, w), path) in enumerate(zip(group, paths, strict=True)):
        j = 0
        while j < len(path):
            if not path[j]:
                j += 1
                continue
            kind, e = (path[j] - 1) // 2, j + 1
            while e < len(path) and path[e] == 2 + 2 * kind:
                e += 1
            sure = np.mean([marginal[k, q, path[q]] for q in range(j, e)])
            a, b = _trimmed(texts[i], w[j][0], w[e - 1][1])
            if sure >= SURE and a < b <= a + LONGEST and DIGITS[kind][0] <= sum(c.isdigit() for c in texts[i][a:b]) <= DIGITS[kind][1]:
                yield i, (int(kind), a, b)
            j = e


def _added(field: Field, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """What the field finds in each text beside the base spans, which it may not touch.

    Runs are decoded BATCH_WORDS words at a time, padding counted, so memory does not grow with a text. Of spans that overlap,
    which the words that runs repeat can give, the one that starts first stays, the longest of equals.
    """
    found: list[set[Span]] = [set() for _ in texts]
    held: list[tuple[int, list[tuple[int, int]]]] = []
    words = 0

    def flush() -> None:
        held.sort(key=lambda r: len(r[1]))
        at = 0
        while at < len(held):
            stop = at + 1
            while stop < len(held) and len(held[stop][1]) * (stop + 1 - at) <= BATCH_WORDS:
                stop += 1
            for i, span in _decoded(field, held[at:stop], texts):
                found[i].add(span)
            at = stop
        held.clear()

    for i, t in enumerate(texts):
        for w in tokens(t):
            held.append((i, w))
            words += len(w)
            if words >= BATCH_WORDS:
                flush()
                words = 0
    flush()
    out: list[list[Span]] = []
    for spans, fixed in zip(found, base, strict=True):
        taken: list[Span] = []
        fixed = sorted((a, b) for _, a, b in fixed)
        starts = [a for a, _ in fixed]
        reach = list(np.maximum.accumulate([b for _, b in fixed])) if fixed else []
        last = -1
        for kind, a, b in sorted(spans, key=lambda s: (s[1], s[1] - s[2], s[0])):
            k = bisect.bisect_left(starts, b)
            if not (k and reach[k - 1] > a) and a >= last:
                taken.append((kind, a, b))
                last = b
        out.append(taken)
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, field: Field, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs.

    Counts and digest are of the base spans; spans has those that the field adds as well. Null and empty texts have none.
    Null and repeated keys are returned as they are; other columns are not read.
    """
    schema = common.row_schema(docs, key, ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")

    def run(batches):
        for b in batches:
            raw = b.column(1)
            for at in range(0, len(raw), 1000):
                texts = [x.decode("utf-8", "replace") for x in raw[at : at + 1000].to_pylist()]
                base = [base_spans(t) for t in texts]
                more = _added(field, texts, base)
                counts = [[sum(s[0] == k for s in spans) for spans in base] for k in range(len(KINDS))]
                digest = [hashlib.sha256(_joined(s).encode()).hexdigest() for s in base]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[at : at + 1000], *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array([_joined(x + y) for x, y in zip(base, more, strict=True)], pa.string())],
                    names=schema.names,
                )

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text")).mapInArrow(run, schema)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return find(docs, train(training_table(docs)))
