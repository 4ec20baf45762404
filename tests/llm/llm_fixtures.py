"""Small tables with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import hashlib
import random
from collections import Counter

import xxhash

WORDS = "the of and river stone light under seven morning garden letter window because another through between".split()


def sentence(random_, n):
    return " ".join(random_.choice(WORDS) + str(random_.randint(0, 30)) for _ in range(n))


def odd_texts(seed=1, n=120):
    r = random.Random(seed)
    texts = [None, "", " ", "\n", "\n\n \n", "one", "a\x0bb\x0cc\td", "é ü ñ", "The SAME line.", " the same LINE. ", "x" * 5000, "퟿ ﷽ 🙂 \u0000"]
    texts += ["\n".join(sentence(r, r.randint(1, 30)) for _ in range(r.randint(1, 6))) for _ in range(n)]
    texts += ["shared footer line\n" + sentence(r, 25) + "\nShared Footer Line " for _ in range(14)]
    texts += [texts[20]] * 15 + [" ".join(sentence(r, 50) for _ in range(80))]
    return texts


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, bucket int, _id long, _row long, document string, d string, n_lines string, token_ids string, fingerprint string, label int, rank int"


def odd_documents(spark, seed=1, n=120):
    """Ids repeat, and some are null; so are sources; one source has most rows."""
    rows = []
    for i, text in enumerate(odd_texts(seed, n)):
        doc_id = None if i % 29 == 7 else i - 1 if i % 31 == 3 else i
        source = None if i % 11 == 5 else "s" + str(i % 4 if i % 3 else 0)
        rows.append((doc_id, text, "en", source, len(text or ""), 0.5, "k", 1, -1, -2, "D", "d", "n", "t", "f", 1, 2))
    rows += rows[25:30]
    return spark.createDataFrame(rows, CLASH)


def empty_documents(spark):
    return spark.createDataFrame([], CLASH)


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, target, full = share * sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in full]
        rest = budget - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in free)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / total for s in names}
        over = {s for s in free if target[s] >= most * sizes[s]}
        if not over or over == set(free):
            return {s: min(target[s], most * sizes[s]) for s in names}
        full |= over


def text_hash(text):
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def n_words(text):
    return len((text or "").encode("utf-8", "surrogatepass").split())


def brute_packets(entries, quantum):
    """(finish, entry number, pass, words) of all packets of (doc_id, text, source, words) entries, in the mix's order."""
    place = lambda i: int(hashlib.md5(str("null" if i is None else i).encode()).hexdigest()[:15], 16)
    first = lambda i: (i is not None, i or 0)
    sizes, queues = Counter(), {}
    for n, (_, _, source, words) in enumerate(entries):
        sizes[source] += words
        queues.setdefault(source, []).append(n)
    target, out = brute_targets(sizes), []
    for source, own in queues.items():
        start = 0
        for n in sorted(own, key=lambda n: (place(entries[n][0]), first(entries[n][0]), text_hash(entries[n][1]))):
            words = entries[n][3]
            for k in (0, 1):
                for at in range(0, words, quantum or max(words, 1)):
                    packet = min(quantum or words, words - at)
                    out.append(((k * sizes[source] + start + at + packet) / target[source], source is None, source or "", start, k, at, n, packet))
            start += words
    return [(p[0], p[6], p[4], p[7]) for p in sorted(out)], target
