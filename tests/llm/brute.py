"""What the operators compute, by plain loops that share no code with them; for small tests."""

import hashlib

import xxhash


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


# -- 2 ----------------------------------------------------------------------------------------


def turns(names, slots):
    """Who owns which slot when all take turns, each in the order of its own permutation."""
    owner = {}
    orders = []
    for name in names:
        digest = hashlib.sha256(name.encode()).digest()
        start, step = int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
        orders.append(iter([(start + i * step) % slots for i in range(slots)]))
    while len(owner) < slots:
        for number, order in enumerate(orders):
            slot = next((s for s in order if s not in owner), None)
            if slot is not None and len(owner) < slots:
                owner[slot] = number
    return [owner[s] for s in range(slots)]


# -- 5 ----------------------------------------------------------------------------------------


def without_repeated_chunks(docs):
    """Line dedup: from every boundary to the next but those within two lines; a line whose hash is 0 modulo 4 above bit 40 ends nothing."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda x: x[0]):
        lines = [] if text is None else text.split("\n")
        n = len(lines)
        ends = {0, n} | {i for i in range(1, n) if (xxhash.xxh3_64_intdigest(lines[i - 1].encode()) >> 40) % 4 != 0}
        gone = set()
        for a in range(n):
            b = next((b for b in range(a + 2, n + 1) if b in ends), None)
            if a in ends and b is not None:
                if tuple(lines[a:b]) in seen:
                    gone |= set(range(a, b))
                seen.add(tuple(lines[a:b]))
        kept = [x for i, x in enumerate(lines) if i not in gone]
        out.append({"doc_id": doc, "n_lines": len(lines), "n_removed": len(lines) - len(kept), "kept_sha256": hashlib.sha256("\n".join(kept).encode()).hexdigest()})
    return out


# -- 6 ----------------------------------------------------------------------------------------


def words_of(text):
    return bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in lower(text)).split()


def hit_by_benchmark(docs, items, window=10):
    """Every place of every document compared with every window."""
    windows = []
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        windows += [(item, tuple(words[i : i + n])) for i in range(len(words) - n + 1 if words else 0)]
    out = []
    for doc, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for item, win in windows:
            for at in range(len(words) - len(win) + 1):
                if tuple(words[at : at + len(win)]) == win:
                    hit.update(range(at, at + len(win)))
                    ids.add(str(item))
        out.append({"doc_id": doc, "n_words": len(words), "n_hit": len(hit), "n_items": len(ids), "items_sha256": hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), "contaminated": bool(hit)})
    return out


# -- 10 ---------------------------------------------------------------------------------------


def fingerprint(text):
    words = lower(text).split()
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64(b" ".join(words[i : i + n]), seed=42).intdigest() for i in range(len(words) - n + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def grams(text, n=5):
    words = lower(text).split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def joined(n, linked):
    """The least number of the component of every number below ``n``."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(a):
                if label[a] != label[b] and linked(a, b):
                    low, high = sorted((label[a], label[b]))
                    label = [low if x == high else x for x in label]
                    changed = True
    return label


# -- 12 ---------------------------------------------------------------------------------------


def alignments(docs, a_path, b_path):
    """Whole texts through both libraries, and every pair of tokens looked at."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(x): x for x in visible} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in visible)}

    def spans(pieces):
        out, at = [], 0
        for i, raw in pieces:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    aligned = []
    for doc, text in docs:
        of_a, of_b = [], []
        if text:
            of_a = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            of_b = [(i, b_bytes(i)) for i in b.encode(text)]
            if not b"".join(x for _, x in of_a) == b"".join(x for _, x in of_b) == (" " + text).encode():
                of_a, of_b = [], []
        of_a, of_b = spans(of_a), spans(of_b)
        links = [(x, y) for x, s, e in of_a for y, u, v in of_b if s < v and u < e]
        ends = sorted({e for _, _, e in of_a} & {e for _, _, e in of_b})
        groups, low = [], 0
        for end in ends:
            groups.append(",".join(str(i) for i, s, _ in of_a if low <= s < end) + "|" + ",".join(str(i) for i, s, _ in of_b if low <= s < end))
            low = end
        aligned.append((doc, of_a, of_b, links, ";".join(groups), len(groups)))
    held = {}
    for _, _, _, links, _, _ in aligned:
        for link in set(links):
            held[link] = held.get(link, 0) + 1
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    return [
        (doc, len(of_a), len(of_b), n_groups, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if of_a else "")
        for doc, of_a, of_b, links, groups, n_groups in aligned
    ]
