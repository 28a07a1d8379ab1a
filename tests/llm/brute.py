"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import regex
import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def quality(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def windows_of(text, items, window):
    """(item, first word, end) of the windows in the text."""
    words = TEXT_WORD.findall(lower(text or ""))
    for name, item in items:
        other = TEXT_WORD.findall(lower(item or ""))
        size = min(window, len(other))
        wins = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)} if other else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in wins:
                yield str(name), i, i + size


def hit_words(text, items, window=13):
    return {k for _, a, b in windows_of(text, items, window) for k in range(a, b)}


def contamination(text, items, window=13):
    n, hit, found = len(TEXT_WORD.findall(lower(text or ""))), hit_words(text, items, window), {x[0] for x in windows_of(text, items, window)}
    return n, len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= n


def fingerprint(text):
    words = SPACE_WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    def valid(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return 8 <= len(digits) <= 15 if kind == "phone" else True

    return [(k, m.start(), m.end()) for k, p in FORMATS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


BLANK = r"[ \t\n\x0b\f\r]"
NAMED = regex.compile(rf"(?<![A-Za-z0-9_])([A-Za-z_]{{2,}}+ ?[=:] ?[\"']?)((?:(?!{BLANK})[^\"'=:;,<>()|]){{4,}}+)")
TOKEN = regex.compile(r"[^ \t\n\x0b\f\r]+")


def trimmed(value):
    return regex.sub(r"[^\p{L}\p{N}]+$", "", value)


def candidates(text):
    """(named, pattern, value, start): values after a name, and tokens of five characters and a digit with the two words before."""
    for m in NAMED.finditer(text or ""):
        yield True, m.group(1).lower(), trimmed(m.group(2)), m.start(2)
    last = 0
    for m in TOKEN.finditer(text or ""):
        if len(m.group()) >= 5 and re.search("[0-9]", m.group()):
            before = regex.search(r"(?:^|[ \t\n\x0b\f\r])([^ \t\n\x0b\f\r]+ [^ \t\n\x0b\f\r]+) \Z", text[last : m.start()])
            lead = regex.match(r"[^\p{L}\p{N}+]*", m.group()).end()
            if before:
                yield False, before.group(1).lower(), trimmed(m.group()[lead:]), m.start() + lead
            last = m.end()


def seed_of(value):
    whole = [k for k, a, b in base_spans(value) if (a, b) == (0, len(value))]
    return whole[0] if whole else "secret" if re.fullmatch("[0-9a-f]{16,64}", value) and re.search("[a-f]", value) and re.search("[0-9]", value) else None


def bootstrap(texts, support=3, confidence=0.7, settled=0.01):
    """All spans of each text: base ones, and candidates that accepted patterns hold."""
    found = [[c for c in candidates(t) if c[1] and len(c[2]) >= 4] for t in texts]
    held = defaultdict(dict)
    for cs in found:
        for _, pattern, value, _ in cs:
            held[pattern][value] = seed_of(value)
    accepted, more = {}, True
    while more:
        known = defaultdict(dict)
        for pattern, values in held.items():
            for v, kind in values.items():
                if kind:
                    known[v][kind] = 1.0
                elif pattern in accepted:
                    kind, score = accepted[pattern]
                    known[v][kind] = max(score, known[v].get(kind, 0.0))
        new = {}
        for pattern, values in held.items():
            for kind in {k for v in values for k in known[v]}:
                weights = [known[v][kind] for v in values if kind in known[v]]
                score = max(sum(weights) / len(values), accepted.get(pattern, (kind, 0.0))[1])
                if len(weights) >= support and score >= confidence and accepted.get(pattern, (kind,))[0] == kind:
                    new[pattern] = max(new.get(pattern, ("", 0.0)), (kind, score), key=lambda x: (x[1], x[0]))
        more = any(s - accepted.get(p, ("", 0.0))[1] > settled for p, (_, s) in new.items())
        accepted = new
    out = []
    for text, cs in zip(texts, found):
        spans = base_spans(text)
        for wanted in (True, False):
            for named, pattern, value, start in sorted(cs, key=lambda c: c[3]):
                if named == wanted and pattern in accepted and all(start + len(value) <= a or b <= start for _, a, b in spans):
                    spans.append((accepted[pattern][0], start, start + len(value)))
        rank = {k: i for i, k in enumerate(FORMATS)}
        out.append(sorted(spans, key=lambda s: (rank.get(s[0], 99), s)))
    return out


def redacted(text, spans):
    out, at = "", 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def blocks(text):
    """Sentences: they end at a mark before white space, at a blank line, and with the text."""
    out = []
    for paragraph in re.split(r"\n[ \t\r\f\v]*(?=\n)|\n[ \t\n\r\f\v]*\Z", text or ""):
        out += re.split(r"(?<=[.!?])[ \t\n\r\f\v]+", paragraph)
    return [words for piece in out if (words := TEXT_WORD.findall(lower(piece)))]


def licenses(text, templates, phrases, threshold=0.8):
    words = TEXT_WORD.findall(lower(text or ""))
    places = sorted((i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    labels, score = {label for _, label in places}, 0.0
    for block in blocks(text):
        have = set(zip(block, block[1:]))
        for label, template in templates:
            other = TEXT_WORD.findall(lower(template))
            wanted = set(zip(other, other[1:]))
            if len(wanted & have) >= threshold * len(wanted) - 1e-9:
                labels.add(label)
                score = max(score, len(wanted & have) / len(wanted))
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, sorted({x for _, x in places}), sorted(labels), score


def repeats(docs, min_words, unit="sentence"):
    """docs: (id, text) in rank order, ids unique."""
    line = re.compile(r"[^\n]+")
    sentence = re.compile(r"(?:[^.!?\n]+|[.!?]+[^.!?\s])*[.!?]*[ \t\n\r\f\v]*", re.ASCII)
    first, out = {}, []
    for name, text in docs:
        flagged, n = [], 0
        for m in (line if unit == "line" else sentence).finditer(text or ""):
            words = [(w.start() + m.start(), w.end() + m.start(), lower(w.group())) for w in SPACE_WORD.finditer(m.group())]
            parts = [[]]
            for w in words:
                parts[-1].append(w)
                if unit != "line" and len(words) > 16 and len(parts[-1]) >= 6 and (7 * len(w[2]) + 3 * ord(w[2][0]) + ord(w[2][-1])) % 6 == 0:
                    parts.append([])
            for part in filter(None, parts):
                key = " ".join(w for _, _, w in part)
                if key in first:
                    flagged.append((n, part[0][0], part[-1][1], len(part), *first[key]))
                else:
                    first[key] = (name, part[0][0])
                n += 1
        runs = defaultdict(list)
        for k, f in enumerate(flagged):
            runs[f[0] - k].append(f)
        out += [(name, *f[1:]) for run in runs.values() if sum(f[3] for f in run) >= min_words for f in run]
    return sorted(out)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def audited(docs, labels):
    """{(part, order, step): counts} for rows (id, text, part) and (id, quality, toxic), by going through the orders document by document."""
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    fails = []
    for i, text, part in docs:
        text = text or ""
        words = SPACE_WORD.findall(text)
        failed = "A" if len(words) < 200 else ""
        failed += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        failed += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
        failed += "D" if re.search("[#$%&*|]", text) else ""
        failed += "E" if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else ""
        fails.append((i, part or "", failed))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for i, part, failed in fails:
            gone = None
            for step, f in enumerate(order, 1):
                counts = out.setdefault((part, order, step), [0] * 6)
                if gone is None and f in failed:
                    gone = step
                    counts[1] += 1
                    counts[4] += i in good
                    counts[5] += i in toxic
                elif gone is not None and f in failed:
                    counts[2] += 1
                counts[0] += gone is None
                counts[3] += failed == f
    shapley = Counter()
    for (part, order, step), counts in out.items():
        shapley[part, order[step - 1]] += counts[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


SEARCH_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, top=50):
    """Sorted (item, rank, id, score) for rows (id, text)."""
    listed = [(i, Counter(SEARCH_TERM.findall(lower(t or "")))) for i, t in docs]
    listed = [(i, c) for i, c in listed if c]
    n_docs, n_terms = len(listed), sum(sum(c.values()) for _, c in listed)
    df = Counter(t for _, c in listed for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(SEARCH_TERM.findall(lower(t or "")))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in listed:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)
