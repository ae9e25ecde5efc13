"""Plain versions of the operators that SQL can't express."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import public_tokenizers


def byte_level():
    """Byte of each character of a byte-level vocabulary."""
    kept = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    table, extra = {}, 256
    for b in range(256):
        if b in kept:
            table[chr(b)] = b
        else:
            table[chr(extra)] = b
            extra += 1
    return table


def alignments(rows):
    """Rows of the alignment query by whole-text encoding and a look-up of every end."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_level()

    def a_bytes(i):
        return bytes(letters[c] for c in a_side.id_to_token(i))

    def b_bytes(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def ends(tokens):
        out, at = [], 0
        for token in tokens:
            at += len(token)
            out.append(at)
        return out

    documents, links = [], collections.Counter()
    for doc_id, text in rows:
        groups, n_a, n_b = [], 0, 0
        if text:
            whole, a, b = (" " + text).encode(), a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            a_parts, b_parts = [a_bytes(i) for i in a], [b_bytes(i) for i in b]
            if b"".join(a_parts) == whole == b"".join(b_parts):
                n_a, n_b, last = len(a), len(b), (0, 0)
                where = {e: i + 1 for i, e in enumerate(ends(b_parts))}
                for i, e in enumerate(ends(a_parts)):
                    if e in where:
                        groups.append((a[last[0] : i + 1], b[last[1] : where[e]]))
                        last = (i + 1, where[e])
        links.update((a[-1], b[-1]) for a, b in groups)
        documents.append((doc_id, n_a, n_b, groups))
    best = collections.Counter()
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, n_a, n_b, groups in documents:
        counts = [(links[a[-1], b[-1]], best[b[-1]]) for a, b in groups]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, len(groups), len(groups), sum(n == m for n, m in counts), sum(n for n, _ in counts), digest))
    return sorted(out, key=repr)


def repairs(rows):
    """Rows of the conversation query: every state's cheapest and ASCII-least edits, from the end backwards."""
    follows, names = {"": "u", "s": "u", "a": "u", "u": "a"}, {"u": "user", "a": "assistant"}
    conversations: dict = {}
    for conv, turn, role, text in rows:
        kept = conversations.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        role = "user" if fault == 4 else role
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = []
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in kept:
            solid = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        n = collections.Counter(faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        turns = {t for t, _, _ in kept if t is not None}
        best = {
            "": (0, "", ()), "a": (0, "", ()), "u": (3, "I", (("assistant", ""),)),
            "s": (6, "II", (("user", ""), ("assistant", ""))),
        }
        for (_, role, text), fault in reversed(list(zip(kept, faults, strict=True))):
            step = {}
            for state in best:
                ways = [(4 + best[state][0], "D" + best[state][1], best[state][2])]
                if fault in ("", "truncated"):
                    more, initial, to = 3 * (fault != ""), role[:1], follows[state]
                    if initial == to or (initial == "s" and state == ""):
                        ways.append((more + best[initial][0], "K" + best[initial][1], ((role, text), *best[initial][2])))
                    ways.append((3 + more + best[to][0], "R" + best[to][1], ((names[to], text), *best[to][2])))
                step[state] = min(ways)
            for _ in range(3):
                for state in step:
                    to = follows[state]
                    step[state] = min(step[state], (3 + step[to][0], "I" + step[to][1], ((names[to], ""), *step[to][2])))
            best = step
        cost, audit, repaired = best[""]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)
