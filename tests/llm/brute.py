"""Plain versions of what the operators compute."""

import math
import re
from collections import defaultdict
from html.parser import HTMLParser

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def components(docs, k, percent=80):
    """doc_id to component, all pairs compared; docs: (doc_id, text)."""
    sets = [(d, shingles(t, k)) for d, t in docs]
    parent = {i: i for i in range(len(sets))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(sets)}


def counts(t):
    t = t or ""
    w, places = WORD.findall(t), {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {k for v in places.values() if len(v) > 1 for i in v for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def _valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and _luhn(d)
    return kind == "email" or 10 <= len(d) <= 15


#: Without these a kind has no match; the plain patterns take quadratic time on long runs.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def spans(t):
    t = t or ""
    found = sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(KINDS.items()) if NEEDS[k] in t for m in re.finditer(p, t) if _valid(k, m.group()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)


def boilerplate(pages, run, copies=None):
    """pages: lists of (kind, text), kind m(ain), c(hrome) or o(pen): for each page, whether its words are boilerplate."""
    copies = list(range(len(pages))) if copies is None else copies
    said, short, streams = defaultdict(set), defaultdict(set), []
    for copy, page in zip(copies, pages, strict=True):
        words, kinds, stretch = [], [], []
        for i, (kind, text) in enumerate(page):
            own = lower(text).split(" ")
            stretch += [len(set(stretch)) + 1 if not kinds or kinds[-1] != kind else stretch[-1]] * len(own)
            words += [(w, i) for w in own]
            kinds += [kind] * len(own)
            if kind == "o" and len(own) < run:
                short[tuple(own)].add(copy)
        runs = [(i, tuple(w for w, _ in words[i : i + run])) for i in range(len(words) - run + 1) if stretch[i] == stretch[i + run - 1]]
        for i, r in runs:
            said[r].add((kinds[i], copy))
        streams.append((words, kinds, runs))
    out = []
    for page, (words, kinds, runs) in zip(pages, streams, strict=True):
        sure, maybe, stays = [set(), set(), set()]
        for i, r in runs:
            main = {c for k, c in said[r] if k == "m"}
            chrome = any(k == "c" for k, _ in said[r])
            if len({c for _, c in said[r]}) > 1 and kinds[i] != "c":
                goes = chrome and len(main) > 1 if kinds[i] == "m" else chrome
                (sure if goes else stays if main else maybe).update(range(i, i + run))
        gone = [j in sure or j in maybe and j not in stays for j in range(len(words))]
        for j, (_, i) in enumerate(words):
            own = tuple(lower(page[i][1]).split(" "))
            gone[j] |= page[i][0] == "o" and len(own) < run and len(short[own]) > 1
        out.append(gone)
    return out


def main_text(page, gone, little):
    words = [(k, w) for k, t in page for w in t.split(" ")]
    kept = [(k, w) for (k, w), g in zip(words, gone, strict=True) if not g]
    main = [w for k, w in kept if k == "m"]
    return " ".join(main if main and len(main) >= little * sum(k != "c" for k, _ in kept) else [w for k, w in kept if k != "c"])


class _Blocks(HTMLParser):
    """Blocks of the plain pages of the test tables: what stands in an article is main, in a few other elements chrome."""

    INLINE = set("a b i em strong span small sup sub code".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.held = [], [], []

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        chrome = any(t in ("head", "nav", "footer", "aside", "form") or "class=ad" in t or t == "header" and "article" not in self.open[:i] for i, t in enumerate(self.open))
        if text:
            self.found.append(("c" if chrome else "m" if "article" in self.open else "o", text))

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.held.append(" ")
        elif tag not in self.INLINE:
            self.flush()
            if tag not in ("meta", "link", "img", "hr", "input"):
                names = dict(attrs).get("class") or dict(attrs).get("id") or ""
                self.open.append(tag + (" class=ad" if tag == "div" and re.search(r"\b(ad|cookie|comments?|sidebar|newsletter|related|share|menu)\b", names) else ""))

    def handle_endtag(self, tag):
        names = [t.split(" ")[0] for t in self.open]
        if tag not in self.INLINE and tag in names:
            self.flush()
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.open or self.open[-1] not in ("script", "style", "title"):
            self.held.append(data)


def main_texts(rows, run, little):
    """page_id to main text; rows: (page_id, url, html)."""
    hosts, out = defaultdict(list), {}
    for i, url, page in rows:
        parser = _Blocks()
        parser.feed(page or "")
        parser.close()
        parser.flush()
        host = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
        hosts[re.sub("^.*@|:[0-9]*$", "", host[1].lower()) if host else ""].append((i, parser.found))
    for pages in hosts.values():
        copies = [" ".join(t for k, t in p if k != "c") for _, p in pages]
        for (i, page), gone in zip(pages, boilerplate([p for _, p in pages], run, copies), strict=True):
            out[i] = main_text(page, gone, little)
    return out


TERM = re.compile(r"[^\W_]+")


def _base(t):
    t = t or ""
    return [(m.start(), m.end(), k, m.group()) for k, p in KINDS.items() for m in re.finditer(p, t) if _valid(k, m.group())]


def _found_terms(t):
    blank = list(t or "")
    for s, e, _, _ in _base(t):
        blank[s:e] = " " * (e - s)
    return [(m.start(), m.end(), m.group()) for m in TERM.finditer("".join(blank))]


def term_spans(texts, generalise, remove, deviations, spread):
    """For each text the spans (start, end, kind) of its disclosing terms."""
    total, copies = len(texts), defaultdict(int)
    for t in texts:
        copies[t or ""] += 1
    entities = {t: {f"{k}:{v.lower() if k == 'email' else v if k == 'ip' else re.sub('[^0-9]', '', v)}" for _, _, k, v in _base(t)} for t in copies}
    terms = {t: {w.lower() for _, _, w in _found_terms(t)} for t in copies}
    everywhere = {t: {w.lower() for w in TERM.findall(t)} for t in copies}
    n_t, n_c, n_ct, seen = (defaultdict(int) for _ in range(4))
    for t, n in copies.items():
        for w in everywhere[t]:
            n_t[w] += n
        for c in entities[t]:
            n_c[c] += n
            for w in terms[t]:
                n_ct[c, w] += n
                seen[c, w] += 1
    told = {}
    for (c, w), joint in n_ct.items():
        p, z2, whole = joint / n_t[w], deviations**2, n_t[w]
        n = whole * seen[c, w] / joint
        low = (p + z2 / (2 * n) - deviations * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
        if n_c[c] < total:
            score = 1 - math.log2(low) / math.log2(n_c[c] / total)
            if score >= generalise:
                told[c, w] = "remove" if score >= remove else "generalise"
    spread_out = {w for (c, w), k in told.items() if k == "remove" and seen[c, w] >= spread}
    out = []
    for t in texts:
        own = defaultdict(set)
        for c in entities[t or ""]:
            for w in terms[t or ""]:
                if (c, w) in told:
                    own[w].add(told[c, w])
        found = []
        for s, e, w in _found_terms(t):
            kinds = own[w.lower()] | ({"remove"} if w.lower() in spread_out else set())
            if kinds:
                shape = "number" if w.isnumeric() else "code" if re.search(r"\d", w) else "name" if w[0].isupper() else "word"
                found.append((s, e, "remove" if "remove" in kinds else shape))
        out.append(found)
    return out


def rewritten(t, spans):
    out, at = [], 0
    for s, e, label in sorted(spans):
        if s >= at:
            out += [t[at:s], label]
        at = max(at, e)
    return "".join(out) + t[at:]
