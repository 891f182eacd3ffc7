"""Plain versions of what the operators compute, shared by tests."""

import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def brute_near(rows, percent=85):
    """doc_id -> (set size, component) by comparing all pairs of sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def brute_ids(texts):
    from tokenizers import Tokenizer

    from lodeframe.llm.packing import vocabulary_path

    tokenizer = Tokenizer.from_file(vocabulary_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def brute_mix(rows, block_words=8192, seed=0):
    """number of the row -> words taken of it, from rows (id, text, source), by going through sources word by word."""
    from lodeframe.llm.mixing import BLOCKS, MOST, WEIGHTS, targets

    md5 = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    ranks = [md5(seed, "" if i is None else i, hashlib.md5((t or "").encode()).hexdigest()) for i, t, _ in rows]
    order = sorted({x for *_, x in rows}, key=lambda x: (x is None, x or ""))
    totals = [sum(n for n, r in zip(sizes, rows, strict=True) if r[2] == x) for x in order]
    per_block = max(block_words, math.ceil(sum(sizes) / BLOCKS))
    taken = [0] * len(rows)
    for s, (x, total, target) in enumerate(zip(order, totals, targets(totals, [WEIGHTS[k % 3] for k in range(len(order))]), strict=True)):
        blocks, left = {}, math.floor(target + 0.5)
        for k, r in enumerate(rows):
            if r[2] == x:
                blocks.setdefault(int(ranks[k][:12], 16) % max(1, math.ceil(total / per_block)), []).append(k)
        for _ in range(MOST):
            for b in sorted(blocks, key=lambda b: (md5(seed, s, b), b)):
                for k in sorted(blocks[b], key=lambda k: (ranks[k], rows[k][0] or 0, sizes[k])):
                    n = min(sizes[k], left)
                    taken[k] += n
                    left -= n
    return taken


def brute_negatives(rows, positives=5, negatives=10):
    """Sorted rows (anchor, positive, rank, negative, scores) out of rows (vec_id, embedding, label), all pairs compared."""
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v]))
    out = []
    for at, (i, label, v) in enumerate(kept):
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for k, (j, other, w) in enumerate(kept) if k != at]
        for minus, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and 30 * -minus <= 100 * -x[0] <= 90 * -minus)[:negatives]
            out += [(i, p, r, j, -minus, -s) for r, (s, j, _) in enumerate(fits, 1)]
    return sorted(out)


def brute_repair(rows):
    """Of one conversation's rows (turn, role, text), in order: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired lines; by a shortest path over (rows done, state) in which whole audits are compared."""
    seen, faults = set(), []
    for _, role, text in rows:
        chars = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip(rows, rows[1:], strict=False)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {(0, ""): (0, "", ())}

    def offer(to, way):
        if to not in best or way < best[to]:
            best[to] = way
            return True
        return False

    for k in range(len(rows) + 1):
        changed = True
        while changed:
            changed = False
            for (done, state), (cost, audit, lines) in list(best.items()):
                if done == k:
                    for role in ("user", "assistant"):
                        if (state, role[0]) in steps:
                            changed |= offer((k, steps[state, role[0]]), (cost + 2, audit + "I", (*lines, f"{role}:")))
        if k == len(rows):
            break
        _, role, text = rows[k]
        for (done, state), (cost, audit, lines) in list(best.items()):
            if done != k:
                continue
            offer((k + 1, state), (cost + 3, audit + "D", lines))
            if faults[k] not in ("blank", "duplicate"):
                late = faults[k] == "truncated"
                for letter, new, more in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if (state, new[:1]) in steps:
                        offer((k + 1, steps[state, new[:1]]), (cost + more + late, audit + letter, (*lines, f"{new}:{text}")))
    cost, audit, lines = min(best[n, s] for n, s in best if n == len(rows) and s in ("", "a"))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, lines


def brute_conversations(rows):
    """conv_id -> (counts, cost, audit, hash) of rows (conv_id, turn, role, text), damaged as op12's contract says."""
    import hashlib
    import zlib

    held = {}
    for conv, turn, role, text in rows:
        own = held.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, own in held.items():
        *counts, lines = brute_repair(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())))
        out[conv] = (*counts, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out
