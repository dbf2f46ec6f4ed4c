"""Plain, slow versions of the operators, for comparison on small tables. No Spark."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring(docs: list[tuple], window: int = 35) -> list[tuple]:
    words = [BLANK_WORDS.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((key, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def decontaminate(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = defaultdict(set)
    for key, t in items:
        w = ALNUM_WORDS.findall((t or "").translate(lower))
        for i in range(max(1, len(w) - window + 1)):
            if w:
                windows[tuple(w[i : i + window])].add(str(key))
    sizes = sorted({len(w) for w in windows})
    out = []
    for key, t in docs:
        w = ALNUM_WORDS.findall((t or "").translate(lower))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((key, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def edits(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def lines(docs: list[tuple], near_chars: int = 20) -> list[tuple]:
    """Documents in order; exact and near repeats by line number."""
    first: dict[str, int] = {}
    near = {}
    out = []
    by_length = defaultdict(list)
    deletions = defaultdict(list)
    for key, t in docs:
        exact, close = [], []
        for i, x in enumerate([] if t is None else t.split("\n")):
            if not re.search(r"[^ \t\n\x0b\f\r]", x):
                continue
            if x in first:
                exact.append(i)
                if near[x]:
                    pass
                continue
            first[x] = len(first)
            forms = {x} | {x[:j] + x[j + 1 :] for j in range(len(x))} if len(x) >= near_chars else set()
            near[x] = any(one_edit(x, y) for f in forms for y in deletions[f])
            for f in forms:
                deletions[f].append(x)
            if near[x]:
                close.append(i)
        out.append((key, 0 if t is None else t.count("\n") + 1, exact, close))
    return out


def pieces(text: str | None, vocabulary: set[bytes], longest: int) -> tuple[int, int]:
    found, n = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode()), 0
    for w in found:
        w, i = b" " + w, 0
        while i < len(w):
            j = min(len(w), i + longest)
            while w[i:j] not in vocabulary:
                j -= 1
            i, n = j, n + 1
    return len(found), n


def url(u: str | None) -> tuple[str, str]:
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def shingles(text: str) -> Counter:
    w = BLANK_WORDS.findall(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a: Counter, b: Counter) -> float:
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 0.0


def alignment(texts: list, a_json: str, b_model: bytes) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text: whole
    texts encoded at once, common ends found by dictionaries."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(a_json)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_proto=b_model)
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}
    names = {i: p for p, i in json.loads(a_json)["model"]["vocab"].items()}
    rows = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = tok.encode(raw.decode(), add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        a_bytes = [bytes(back[c] for c in names[i]) for i in a]
        pieces = [sp.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
        if not t or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            rows.append(([], [], [], ""))
            continue
        ends, at = {}, 0
        for i, x in enumerate(a_bytes):
            at += len(x)
            ends[at] = i
        links, at = [], 0
        for j, x in enumerate(b_bytes):
            at += len(x)
            if at in ends:
                links.append((ends[at], j))
        groups, i0, j0 = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
            i0, j0 = i + 1, j + 1
        rows.append((a, b, [(a[i], b[j]) for i, j in links], sha(";".join(groups))))
    count = Counter(p for r in rows for p in r[2])
    top: dict = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [
        (len(a), len(b), len(k), len(k), sum(count[p] == top[p[1]] for p in k), sum(count[p] for p in k), s) for a, b, k, s in rows
    ]


def secrets(text) -> list[tuple]:
    """Base spans by start, then kind: the patterns tried at every place, letter by letter."""
    text = text or ""
    kinds = [
        (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        (r"AKIA[A-Z0-9]+", 0, 20),
        (r"[0-9a-f]+", 0, 24),
    ]
    out = []
    for k, (pattern, group, least) in enumerate(kinds):
        at = 0
        while at < len(text):
            m = re.compile(pattern).match(text, at)
            if m and len(m.group(group)) >= least:
                out.append((m.start(), k, m.end()))
            at = m.end() if m else at + 1
    return sorted(out)
