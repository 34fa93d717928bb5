"""Brute-force versions of the corpus operators, and documents that are hard in small ways."""

import collections
import hashlib
import random
import re

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"
#: Names that operators use inside, as columns of their input.
CLASHES = ("key", "size", "set", "h", "body", "bucket", "label", "ids", "rank", "rows", "kept", "score", "tokens", "held_out",
           "stays", "sha", "keep_id", "text_sha256")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def documents(seed=3, copies=40):
    """Copies, near copies, shared passages, short, blank, null and long texts, ties and a hot source."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(40), text(90)
    texts = [base] * 5 + [base.replace(" ", "\n", 3), base.upper(), "  " + base]
    for _ in range(copies):
        words = base.split()
        words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [text(30) + " " + passage + " " + text(25) for _ in range(12)]
    texts += [text(rng.randrange(1, 60)) for _ in range(20)]
    texts += ["", None, None, " \t\n", "one", "one two", "ONE two", "aaaa " * 200, "ab" * 300, text(6000), "ü" * 150, "<|endoftext|> x"]
    rows = []
    for i, t in enumerate(texts):
        source = None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}"
        rows.append((i, t, ["en", "fr", None][i % 3], source, len(t or ""), *["x"] * len(CLASHES)))
    rng.shuffle(rows)
    return rows


def repeats(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        removed = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                removed[p : p + 100] = True
            seen.add(data[p : p + 100])
        starts = int((np.diff(np.concatenate([[0], removed.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~removed])
        out.append((doc_id, len(data), int(removed.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def similar(rows):
    sets = {}
    for doc_id, text in rows:
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
        sets[doc_id] = set(grams)
    name = {i: i for i in sets}
    found = collections.defaultdict(list)
    for i in sorted(sets):
        near = collections.Counter(j for g in sets[i] for j in found[g])
        for j, k in near.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k) and name[i] != name[j]:
                a, b = sorted((name[i], name[j]))
                name = {n: a if c == b else c for n, c in name.items()}
        for g in sets[i]:
            found[g].append(i)
    return sorted((i, len(sets[i]), name[i]) for i in sets)


def linked(rows, cosine=0.95):
    fine = {i: np.array(e, float) / max(map(abs, e)) for i, e in rows  # scaled, as squares of large components overflow
            if e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    name, count = {i: i for i, _ in rows}, collections.Counter()
    for i in fine:
        for j in fine:
            x, y = fine[i], fine[j]
            if i < j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                count[i] += 1
                count[j] += 1
                a, b = sorted((name[i], name[j]))
                name = {n: a if c == b else c for n, c in name.items()}
    return sorted((i, count[i], name[i], name[i] == i) for i, _ in rows)
