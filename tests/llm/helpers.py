"""Brute-force versions and small tables for the tests of this folder."""

import re

from trajlens.llm.shingles import set_digest, shingle_set

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    found = []
    for order, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                found.append((m.start(), order, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def near_components(texts):
    """{id: (shingles, smallest id reachable)} by comparing every two sets with exact integers."""
    sets = {i: frozenset(shingle_set(t).tolist()) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = sets[i], sets[j]
            if 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 75 * (len(a) + len(b) - common):
                    x, y = root(i), root(j)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def least_edits(item, text):
    """Least edit distance of a sequence of words to any run of a text's words."""
    row = [0] * (len(text) + 1)
    for a in item:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (a != b)))
        row = new
    return min(row)


def text_key(text):
    return set_digest(shingle_set(text))
