"""Page furniture and broken words in the token sequence of one document.

Works on plain lists of one document (or one key range of a very long one, with some tokens of its
neighbours), in reading order. Nothing here decides alone: it measures what the models of
``scans`` weigh. Positions come from the page and line of a token where known; sequences without
them (plain text) are judged by what repeats at page distance.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

HYPHEN_MARKS = "-=¬⸗‐‑－"
SOFT = "­"
OUTER = ".,;:!?()[]{}«»„“”\"'‚‘’›‹*"
LABELS = {"s", "side", "sid", "seite", "page", "p", "pag", "sida"}
ORNAMENT = re.compile(r"^[—–\-*·•~=]+$")
NUMBER = re.compile(r"^[\[(—–\-]*([0-9OolIiZSBJTbqgA|]{1,5}|[ivxlcIVXLCj1]{1,8})[\])—–\-.:]*$")
FRAMED = re.compile(r"^[\[(—–\-]+[0-9A-Za-z|]{1,6}[\])—–\-.]+$")
ROMAN = re.compile(r"^(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
READ_AS = str.maketrans("OoIliZSBJTbqgA|j", "0011125837699411")

# what is measured of a token, one bit each
FIRST_LINE, LAST_LINE, NUMERIC, SEQUENCE, FRAME, REPEATED, SHORT_LINE, CAPITALS, NO_LINES, SLOT, BESIDE_NUMBER, LINE_EDGE = (1 << i for i in range(12))
BITS = 12


def bare_key(visible: str) -> str:
    """The word compared: a visible form without soft hyphens, outer punctuation and long s."""
    t = visible.replace(SOFT, "").replace("ſ", "s")
    return t.strip(OUTER) or t


def plain_case(key: str) -> str:
    """Lower case, if the capitals stand where capitals stand: first, or all."""
    return key.lower() if key[1:] == key[1:].lower() or key == key.upper() else key


def roman_value(t: str) -> int | None:
    t = t.lower().replace("j", "i").replace("1", "i")
    if not t or not ROMAN.match(t):
        return None
    value, last = 0, 0
    for c in reversed(t):
        v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c]
        value += v if v >= last else -v
        last = max(last, v)
    return value


def number_value(text: str) -> int | None:
    """The value of a printed page number, usual misreadings of digits allowed; None if it is none."""
    m = NUMBER.match(text)
    if not m:
        return None
    core = m[1]
    if any(c.isdigit() for c in core) or FRAMED.match(text):
        digits = core.translate(READ_AS)
        if digits.isdigit():
            return int(digits)
    return roman_value(core)


def close(a: str, b: str) -> bool:
    """Whether two words are the same but for some misread characters."""
    if a == b:
        return True
    most, least = max(len(a), len(b)), min(len(a), len(b))
    if most - least > 2 or least < 3:
        return False
    front = 0
    while front < least and a[front] == b[front]:
        front += 1
    back = 0
    while back < least - front and a[-1 - back] == b[-1 - back]:
        back += 1
    if (front + back) * 2 >= most:
        return True
    if (not front and not back) or len(set(a) & set(b)) * 2 < most:
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.65


def is_label(text: str) -> bool:
    return text.rstrip(".:").lower() in LABELS


def number_run(tokens: list[str], at: int, end: int, step: int) -> tuple[int, int | None]:
    """From an edge of a line inwards: how many tokens belong to a page number, and its value."""
    n, i, value = 0, at, None
    while i != end:
        t = tokens[i]
        if value is None and (v := number_value(t)) is not None and not ORNAMENT.match(t):
            value = v
        elif not ORNAMENT.match(t) and not (is_label(t) and (step == 1) == (value is None)):
            break
        n += 1
        i += step
    return (n, value) if value is not None else (0, None)


def paged(tokens: list[str], keys: list[str], spans: list[tuple[int, list[tuple[int, int]]]], code: list[int]) -> None:
    """Measure the first and last lines of pages; ``spans`` lists (page, [(from, to) of its lines])."""
    runs: dict[int, list[tuple[str, range, int]]] = {}
    firsts: list[tuple[int, int, list[int]]] = []
    offsets: dict[tuple[str, int], int] = {}
    slots: dict[str, int] = {}
    for p, (page, lines) in enumerate(spans):
        (a, b), (c, d) = lines[0], lines[-1]
        found = []
        n, v = number_run(tokens, a, b, 1)
        if n:
            found.append(("first", range(a, a + n), v))
        m, w = number_run(tokens, b - 1, a - 1, -1)
        if m and m < b - a:
            found.append(("first", range(b - m, b), w))
        if len(lines) > 1:
            m, w = number_run(tokens, d - 1, c - 1, -1)
            if m:
                found.append(("last", range(d - m, d), w))
        runs[p] = found
        for slot in {f[0] for f in found}:
            slots[slot] = slots.get(slot, 0) + 1
        for slot, value in {(f[0], f[2] - page) for f in found}:
            offsets[slot, value] = offsets.get((slot, value), 0) + 1
        numbered = {i for f in found if f[0] == "first" for i in f[1]}
        firsts.append((a, b, [i for i in range(a, b) if i not in numbered]))
    alike = repeated_lines([[keys[i].lower() for i in rest] for _, _, rest in firsts])
    agreed = {s: max((n, o) for (t, o), n in offsets.items() if t == s) for s in slots}
    for p, (page, lines) in enumerate(spans):
        (a, b), (c, d) = lines[0], lines[-1]
        for i in range(a, b):
            code[i] |= FIRST_LINE | (SHORT_LINE if b - a <= 5 else 0)
        if len(lines) > 1:
            for i in range(c, d):
                code[i] |= LAST_LINE | (SHORT_LINE if d - c <= 3 else 0)
        for slot, where, value in runs[p]:
            count, offset = agreed[slot]
            for i in where:
                code[i] |= NUMERIC | LINE_EDGE
                if count >= 2 and value - page == offset:
                    code[i] |= SEQUENCE
                if count >= 2 and count * 2 >= len(spans):
                    code[i] |= SLOT
                if FRAMED.match(tokens[i]) or ORNAMENT.match(tokens[i]) or is_label(tokens[i]):
                    code[i] |= FRAME
        _, _, rest = firsts[p]
        if rest:
            capital = sum(tokens[i][:1].isupper() for i in rest) * 2 > len(rest)
            for i in rest:
                code[i] |= (REPEATED if alike[p] else 0) | (CAPITALS if capital else 0) | (BESIDE_NUMBER if len(rest) < b - a else 0)


def repeated_lines(lines: list[list[str]]) -> list[bool]:
    """Which of the first lines of pages return on another page, misread words allowed: lines of about
    the same length with more than half of their words alike, or all.

    A line is compared with those of the pages around, and with all that share one of its words, the
    rarest of which are looked up first; so lines of any length meet across any number of pages.
    """
    holders: dict[str, list[int]] = {}
    for p, words in enumerate(lines):
        for w in set(words):
            holders.setdefault(w, []).append(p)
    out = [False] * len(lines)
    for p, words in enumerate(lines):
        if not words or out[p]:
            continue
        shared: dict[int, int] = {}
        for w in sorted(set(words), key=lambda w: len(holders[w])):
            for q in holders[w]:
                shared[q] = shared.get(q, 0) + 1
            if len(shared) > 64:
                break
        others = sorted({*range(max(0, p - 6), min(len(lines), p + 7)), *shared} - {p}, key=lambda q: abs(q - p))
        for q in others:
            other = lines[q]
            # in a long line a quarter of the words must be the same before misread ones are looked for
            if abs(len(other) - len(words)) > 1 or (len(words) > 8 and shared.get(q, 0) * 4 < len(words)):
                continue
            same = sum(any(close(w, x) for x in other) for w in words)
            if same * 2 > len(words) or same == len(words):
                out[p] = True
                if len(other) == len(words) and same == len(words):
                    out[q] = True
                break
    return out


def page_distance(numbers: list[tuple[int, int]], by_value: dict[int, list[int]]) -> tuple[int, int]:
    """Between how many tokens the next page number may stand: usual pages, and pages as far apart as
    most numbers of the sequence that count up three times at even distances."""
    steps = []
    for i, v in numbers:
        for j in by_value.get(v + 1, ()):
            if j > i and any(2 * abs((k - j) - (j - i)) <= j - i for k in by_value.get(v + 2, ()) if k > j):
                steps.append(j - i)
                break
    usual = (25, 260)
    if len(steps) < 3:
        return usual
    middle = sorted(steps)[len(steps) // 2]
    return min(usual[0], max(3, middle // 2)), max(usual[1], middle * 2)


def unpaged(tokens: list[str], keys: list[str], code: list[int]) -> None:
    """Measure a sequence without lines: page numbers that count up, words that return with them."""
    n = len(tokens)
    for i in range(n):
        code[i] |= NO_LINES
    numbers: list[tuple[int, int, range]] = []
    for i in range(n):
        v = number_value(tokens[i])
        if v is None or ORNAMENT.match(tokens[i]) or (not any(c.isdigit() for c in tokens[i]) and not tokens[i].endswith(".") and not FRAMED.match(tokens[i])):
            continue
        a, b = i, i + 1
        if a and (is_label(tokens[a - 1]) or (ORNAMENT.match(tokens[a - 1]) and b < n and ORNAMENT.match(tokens[b]))):
            b += not is_label(tokens[a - 1])
            a -= 1
        numbers.append((i, v, range(a, b)))
    by_value: dict[int, list[int]] = {}
    for i, v, _ in numbers:
        by_value.setdefault(v, []).append(i)
    least, most = page_distance([(i, v) for i, v, _ in numbers], by_value)
    near = lambda i, v, step: any(least <= (j - i) * step <= most for j in by_value.get(v + step, ()))
    strong = []
    for i, v, where in numbers:
        framed = bool(FRAMED.match(tokens[i])) or len(where) > 1
        up, down = near(i, v, 1), near(i, v, -1)
        for j in where:
            code[j] |= NUMERIC | (FRAME if framed else 0) | (SEQUENCE if up or down else 0) | (SLOT if up and down else 0)
        if framed or (up and down) or ((up or down) and v < 200):
            strong.append(where)
    beside = set()
    for where in strong:
        beside.update(range(where.stop, min(n, where.stop + 5)))
        beside.update(range(max(0, where.start - 5), where.start))
    lower = [k.lower() for k in keys]
    seen: dict[tuple[str, str], list[int]] = {}
    for i in range(n - 1):
        if tokens[i][:1].isupper() and len(keys[i]) > 1 and not code[i] & NUMERIC and tokens[i][-1] not in ".!?:;,":
            seen.setdefault((lower[i], lower[i + 1]), []).append(i)
    heads: list[list[str]] = []
    for (_, _), at in seen.items():
        if len(at) >= 2 and at[-1] - at[0] >= 25:
            size = 2
            while all(i + size < n for i in at[:2]) and at[0] + size < at[1] and close(lower[at[0] + size], lower[at[1] + size]) and not code[at[0] + size] & NUMERIC:
                size += 1
            heads.append(lower[at[0] : at[0] + size])
    starts = {h[0]: h for h in heads}
    for i in range(n):
        if not tokens[i][:1].isupper():
            continue
        head = starts.get(lower[i])
        if head is None:
            head = next((h for h in heads if len(h[0]) > 3 and i + 1 < n and lower[i + 1] == h[1] and close(lower[i], h[0])), None)
        if head and i + len(head) <= n and all(close(x, y) for x, y in zip(head, lower[i : i + len(head)], strict=True)):
            for j in range(i, i + len(head)):
                code[j] |= REPEATED | CAPITALS
    for i in beside:
        if not code[i] & NUMERIC:
            code[i] |= BESIDE_NUMBER | (CAPITALS if tokens[i][:1].isupper() else 0)


def surely_furniture(code: int) -> bool:
    """Enough for a broken word to be continued behind it."""
    if code & NUMERIC:
        return bool(code & (SEQUENCE | FRAME | SLOT)) and bool(code & (FIRST_LINE | LAST_LINE | FRAME | SLOT))
    return bool(code & REPEATED) and bool(code & (FIRST_LINE | NO_LINES))


def measure(tokens: list[str], keys: list[str], pages: list[int | None], lines: list[int | None]) -> list[int]:
    """The bits of every token."""
    code = [0] * len(tokens)
    if all(p is None for p in pages):
        unpaged(tokens, keys, code)
        return code
    spans: list[tuple[int, list[tuple[int, int]]]] = []
    page = line = None
    for i, (p, n) in enumerate(zip(pages, lines, strict=True)):
        p, n = (page, line) if p is None else (p, n)
        if not spans or p != page:
            spans.append((p or 0, [(i, i + 1)]))
        elif n != line:
            spans[-1][1].append((i, i + 1))
        else:
            a, _ = spans[-1][1][-1]
            spans[-1][1][-1] = (a, i + 1)
        page, line = p, n
    paged(tokens, keys, spans, code)
    return code


# ---------------------------------------------------------------------------------------------
# Words broken over line ends

NO_MARK, HYPHEN, SOFT_MARK = 0, 1, 2


def mark_of_visible(t: str) -> int:
    """Which hyphen mark a token ends in: none, a hyphen a word may itself end in, or a soft one."""
    if len(t) < 2 or t[-1] not in HYPHEN_MARKS or FRAMED.match(t) or ORNAMENT.match(t):
        return NO_MARK
    return HYPHEN if t[-1] == "-" else SOFT_MARK


def continuations(marks: list[int], code: list[int], hyphenated: list[bool | None], pages: list[int | None], lines: list[int | None]) -> list[int]:
    """For every token the index of the token that may continue its word, or -1.

    That is the next token behind any furniture, if the token ends in a mark and is not known to
    stand inside a line, or without mark if it ends a line, or is flagged and the line is unknown.
    """
    out = [-1] * len(marks)
    behind = [len(marks)] * (len(marks) + 1)  # the first token from here on that is no furniture
    for i in range(len(marks) - 1, -1, -1):
        behind[i] = behind[i + 1] if surely_furniture(code[i]) else i
    for i, mark in enumerate(marks):
        if not mark and (lines[i] is None and not hyphenated[i]):
            continue
        if code[i] & NUMERIC and surely_furniture(code[i]):
            continue
        j = i + 1
        if not mark and j < len(marks) and lines[j] == lines[i] and pages[j] == pages[i] and lines[i] is not None:
            continue
        j = behind[min(j, len(marks))]
        if j >= len(marks):
            continue
        known = lines[i] is not None and lines[j] is not None
        ends = known and (lines[i] != lines[j] or pages[i] != pages[j])
        if mark and (ends or not known) or (not mark and (ends or (not known and hyphenated[i]))):
            out[i] = j
    return out
