"""The contracts of the queries in plain Python over small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

TOKENIZER = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    words = BLANK_WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4)))


def op1(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    shared = Counter()
    for ids in index.values():
        shared.update(itertools.combinations(ids, 2))
    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n) and docs[i][0] is not None and docs[j][0] is not None:
            a, b = sorted((find(docs[i][0]), find(docs[j][0])))
            parent[b] = a
    return sorted((repr(d), len(s), None if d is None else find(d)) for (d, _), s in zip(docs, sets))


def op2(docs):
    out = []
    for d, t in docs:
        words = ALNUM_WORD.findall(lower(t))
        places = []
        for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
            p = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i: i + len(p)] == p]
        at = [i for i, _ in places]
        out.append((d, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    return out


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def le32(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def op3(docs):
    return [(d, len(ids := ids_of(t)), hashlib.sha256(le32(ids)).hexdigest(), sha(TOKENIZER.decode(ids, skip_special_tokens=False))) for d, t in docs]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def op6(docs):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(x := re.sub("[^0-9]", "", m)) <= 19 and luhn(x)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    out = []
    for d, t in docs:
        spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(m[0])] for k, (p, ok) in kinds.items()}
        out.append((d, *[len(spans[k]) for k in kinds], sha(",".join(s for k in kinds for s in spans[k]))))
    return out


def pieces(docs, capacity=2048):
    out = []
    for d, t in docs:
        ids = [*ids_of(t), 0]
        first = (len(ids) - 1) % capacity + 1
        for n, start in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[start: first if n == 0 else start + capacity]
            out.append((d, n, start, len(part), zlib.crc32(le32(part))))
    return out


def op9(docs):
    out = []
    for d, t in docs:
        t = t or ""
        words = BLANK_WORD.findall(t)
        windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if BLANK_WORD.search(x)]
        row = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        out.append((d, *row, row[0] < 50 or 100 * row[4] > 50 * row[0]))
    return out


def op10(docs):
    assign = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = (("assign", assign, lambda m: len(m[1]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24))
    out = []
    for d, t in docs:
        spans = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m)]
        n = Counter(s[1] for s in spans)
        out.append((d, n[0], n[1], n[2], sha(",".join(s for _, _, s in sorted(spans)))))
    return out


def op11(rows, k=16, rounds=3):
    kept = [(i, [math.floor(Fraction(x) * 64) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    points = [x for _, x in sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, p)), i) for i, p in enumerate(points))

    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(nearest(x)[1], []).append(x)
        for i, xs in members.items():
            points[i] = [sum(t) // len(xs) for t in zip(*xs)]
    found = [(i, *nearest(x)) for i, x in kept]
    total = Counter()
    for _, d, c in found:
        total[c] += d

    def fits(n):
        return n if n < 2**63 else None

    return [(i, c, fits(d), fits(total[c]), fits(sum(total.values())), sha(",".join(map(str, points[c])))) for i, d, c in found]


LITERAL = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
LITERAL.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def two_sided(text):
    """(id, bytes) of both sides' tokens."""
    if not text:
        return [], []
    a = [(i, bytes(BYTE_OF[c] for c in LITERAL.id_to_token(i))) for i in LITERAL.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode()) for i in PIECES.encode(text)]
    wanted = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == wanted == b"".join(x for _, x in b) else ([], [])


def op12(docs):
    counts, made = Counter(), []
    for d, t in docs:
        a, b = two_sided(t)
        ends = []
        for side in (a, b):
            at, found = 0, {}
            for n, (_, token) in enumerate(side):
                at += len(token)
                found[at] = n
            ends.append(found)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(a[ends[0][c]][0], b[ends[1][c]][0]) for c in cuts]
        counts.update(links)
        i = j = 0
        shown = []
        for c in cuts:
            shown.append(",".join(str(x) for x, _ in a[i: ends[0][c] + 1]) + "|" + ",".join(str(x) for x, _ in b[j: ends[1][c] + 1]))
            i, j = ends[0][c] + 1, ends[1][c] + 1
        made.append((d, len(a), len(b), len(cuts), links, sha(";".join(shown)) if a else ""))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(d, na, nb, n, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), h) for d, na, nb, n, links, h in made]


def op13(docs, k=50):
    least = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - k + 1 if d is not None else 0):
            least[b[i: i + k]] = min(d, least.get(b[i: i + k], d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - k + 1 if d is not None else 0):
            if least[b[i: i + k]] < d:
                gone[i: i + k] = [True] * k
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out
