"""Plain versions of the operators over rows (doc_id, text), for comparison."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import tiktoken
import xxhash

from reelgraph.llm import bpe, queries

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def op1(rows):
    import public_tokenizers as P

    codec = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(queries.TOKENIZER)), special_tokens={})
    out = []
    for i, t in rows:
        ids = codec.encode_ordinary(t or "")
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    return out


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    """{fingerprint: set of fingerprints within reach}."""
    left, out = {fingerprint(t) for _, t in rows}, {}
    while left:
        group, todo = set(), [min(left)]
        while todo:
            f = todo.pop()
            if f not in group:
                group.add(f)
                todo += [g for g in left if (f ^ g).bit_count() <= 4]
        left -= group
        out |= dict.fromkeys(group, group)
    return out


def op4(rows):
    reach = components(rows)
    name = {f: min((i for i, t in rows if i is not None and fingerprint(t) in reach[f]), default=None) for f in reach}
    return [(i, f"{fingerprint(t):016x}", name[fingerprint(t)]) for i, t in rows]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def op5(rows):
    """Without the column of all spans."""
    out = []
    for i, t in rows:
        found = base_spans(t or "")
        n = Counter(k for k, *_ in found)
        out.append((i, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))))
    return out


def op7(rows, width=35):
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[k : k + width]) for w in texts for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = {j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
        out.append((i, len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def op8(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = []
    for i, t in rows:
        w, hit, found = words_of(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if k + n <= len(w) and (ids := windows.get(tuple(w[k : k + n]))):
                    found |= ids
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def op9(rows):
    """Without the verdict."""
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        repeat = {j for k, g in enumerate(grams) if n[g] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)))
    return out


def op10(rows, width=100):
    """Rows with distinct ids, but for rows that repeat."""
    docs = sorted({(i is None, i or 0, (t or "").encode()) for i, t in rows})
    first = {}
    for k, (*_, t) in enumerate(docs):
        for i in range(len(t) - width + 1):
            first.setdefault(t[i : i + width], (k, i))
    done = {}
    for k, (none, i, t) in enumerate(docs):
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if first[t[p : p + width]] != (k, p):
                gone[p : p + width] = b"\1" * width
        runs = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        done[none, i, t] = (len(t), sum(gone), runs, sha(bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return [(i, *done[i is None, i or 0, (t or "").encode()]) for i, t in rows]


def op2(rows):
    out = []
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"[^/?#]*", rest)[0], re.match(r"[^/?#]*([^?#]*)", rest)[1]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        *_, rule, verdict = max(fits, default=(0, 0, None, "allow"))
        out.append((i, host, path, rule, verdict))
    return out


def op6(rows):
    """Rows (page_id, html)."""
    import base64

    least = {}
    for i, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = []
    for i, h in rows:
        data = (h or "").encode()
        first = least.get(h or "")
        revisit = first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return out


def op11(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    coded = lambda fields: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        text = r[4] if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[4].replace("\n", "")
        groups[r[1]].append((r[0] is not None, r[0] or 0, coded(r), k, coded([*r[:4], text])))

    def tree(leaves):
        """(root, for each leaf the siblings before and after on each level)."""
        steps, at, now = [[] for _ in leaves], list(range(len(leaves))), leaves
        while len(now) > 1:
            for k, i in enumerate(at):
                first = i - i % 3
                steps[k].append(("".join(now[first:i]), "".join(now[i + 1 : first + 3])))
                at[k] = i // 3
            now = [sha("".join(now[i : i + 3])) for i in range(0, len(now), 3)]
        return now[0], steps

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, upper = tree([trees[g][0] for g in names]) if names else (None, [])
    out = []
    for g, above in zip(names, upper, strict=True):
        for (*_, leaf, k, now), steps in zip(sorted(groups[g]), trees[g][1], strict=True):
            steps = steps + above
            proof = sha("".join(a + b for a, b in steps))
            for a, b in steps:
                now = sha(a + now + b)
            out.append((rows[k][0], leaf, trees[g][0], root, proof, now, now == root))
    return out


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


def op12(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
    return variants({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})


def variants(counts):
    by = defaultdict(list)
    for w in counts:
        by[len(w)].append(w)
    near = {w: [x for d in (-1, 0, 1) for x in by[len(w) + d] if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= 10 * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return out


def op13(rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(P.path(queries.COUNTED))
    sizes = [len(codec.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    return [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, sizes, strict=True)]
