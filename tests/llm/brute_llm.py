"""Plain Python versions of the operators, for small tables."""

import hashlib
import re

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, hash string"


def docs_frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, "en", None, len(t) if t is not None else None, "x", None) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def by_id(frame, *columns):
    return sorted(tuple(r[c] for c in ("doc_id", *columns)) for r in frame.collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def removed_units(rows, split, join, width):
    """doc_id to (units, removed, kept) where units are words or lines."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        units = split(text)
        gone = set()
        for at in range(len(units) - width + 1):
            key = tuple(units[at : at + width])
            if key in seen:
                gone.update(range(at, at + width))
            else:
                seen[key] = (i, at)
        out[i] = len(units), len(gone), join.join(u for k, u in enumerate(units) if k not in gone)
    return out


def removed_rows(rows, split, join, width):
    """(doc_id, units, removed, kept) of every row; ids may repeat or miss, rows of an id are ordered by text hash."""
    order = sorted((i, text_hash(t), k) for k, (i, t) in enumerate(rows) if i is not None)
    named = {number: rows[k][1] for number, (_, _, k) in enumerate(order)}
    cut = removed_units(named.items(), split, join, width)
    out = [(order[number][0], *cut[number]) for number in named]
    return sorted(out + [(None, len(split(t)), 0, join.join(split(t))) for i, t in rows if i is None], key=str)


def text_hash(text):
    """Spark's xxhash64 of one string: the seed passes through a null."""
    value = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lined(text):
    return text.split("\n") if text else []


def fingerprint(text, width=4):
    words = spaced(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def near_components(prints, radius=4):
    """doc_id to the smallest id reachable over links of at most ``radius`` bits."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def leak_rows(docs, items, size=10):
    """(doc_id, n_words, n_hit, item ids as sorted strings)."""
    phrases = {}
    for item, text in items:
        words = plain_words(text)
        for at in range(max(1, len(words) - size + 1)) if words else ():
            phrases.setdefault(tuple(words[at : at + size]), set()).add(item)
    sizes, out = sorted({len(p) for p in phrases}), []
    for i, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for at in range(len(words) - n + 1):
                if (own := phrases.get(tuple(words[at : at + n]))) is not None:
                    hit.update(range(at, at + n))
                    found |= own
        out.append((i, len(words), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out)
