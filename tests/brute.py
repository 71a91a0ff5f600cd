"""Plain-Python brute force for the splitters, written from the rules, used as the expected value in tests."""

import re

SEPS = ["\n\n", "\n", "。", "！", "？", "；", "，", " "]


def fences(text):
    found, opened, pos = [], None, 0
    for line in text.split("\n"):
        if line.startswith("```"):
            if opened is None:
                opened = pos
            else:
                found.append((opened, pos + 3))
                opened = None
        pos += len(line) + 1
    if opened is not None:
        found.append((opened, len(text)))
    return found


def touches(a, b, ranges):
    return any(a < e and b > s for s, e in ranges)


def cut(text, base, seps, size, ranges):
    if len(text) <= size:
        return [(text, base)] if text else []
    for n, sep in enumerate(seps):
        if sep not in text:
            continue
        parts, last, at = [], 0, text.find(sep)
        while at >= 0:
            if not touches(base + at, base + at + len(sep), ranges):
                parts.append((text[last : at + len(sep)], base + last))
                last = at + len(sep)
            at = text.find(sep, at + len(sep))
        if not parts:
            continue
        parts.append((text[last:], base + last))
        out, buf, buf_at = [], "", 0
        for part, start in parts:
            if len(part) > size:
                if buf:
                    out.append((buf, buf_at))
                buf = ""
                out += cut(part, start, seps[n + 1 :], size, ranges)
            elif buf and len(buf) + len(part) > size:
                out.append((buf, buf_at))
                buf, buf_at = part, start
            else:
                if not buf:
                    buf_at = start
                buf += part
        if buf:
            out.append((buf, buf_at))
        return out
    out, i = [], 0
    while i < len(text):
        j = min(i + size, len(text))
        inside = [(s, e) for s, e in ranges if s <= base + j < e]
        if inside:
            j = min(inside[0][1], base + len(text)) - base
            while j < len(text) and text[j] == "\n":
                j += 1
        if j <= i:
            j = min(i + size, len(text))
        out.append((text[i:j], base + i))
        i = j
    return out


def split(text, size, overlap=0):
    ranges = fences(text)
    joined = []
    for content, start in cut(text, 0, SEPS, size, ranges):
        if joined and "\n" not in content and re.match(r"#{1,6}\s", content):
            joined[-1] = (joined[-1][0] + "\n" + content, joined[-1][1])
        else:
            joined.append((content, start))
    crumbs, i = list(joined), 0
    while i < len(crumbs):
        content, start = crumbs[i]
        near = any(0 <= start - e <= 2 for _, e in ranges)
        if not content.strip() and len(content) <= 2 and near:
            if i > 0:
                crumbs[i - 1] = (crumbs[i - 1][0] + content, crumbs[i - 1][1])
            elif len(crumbs) > 1:
                crumbs[1] = (content + crumbs[1][0], crumbs[1][1])
            del crumbs[i]
        else:
            i += 1
    out = []
    for content, start in crumbs:
        if out and overlap:
            before = out[-1][0]
            if not touches(start - min(overlap, len(before)), start, ranges):
                content = before[-overlap:] + content
        out.append((content, start))
    return out
