"""Plain Python models to check term operators against."""

import math


def model_stats(docs, terms):
    n = len(docs)
    df = {t: sum(t in d for d in docs) for t in terms}
    return {t: math.log((n + 1) / (c + 1)) + 1 if c else 0.0 for t, c in df.items()}, df


def model_relevant(text, entries, idf, df, limit):
    """Entries (term, target, ...) by score, stable in list order."""
    places = [i for i, e in enumerate(entries) if df[e[0]] and e[0] in text]
    places.sort(key=lambda i: (-(text.count(entries[i][0]) * idf[entries[i][0]]), i))
    return [entries[i] for i in places[:limit]]


def _stands_free(text, start, stop):
    around = text[max(start - 1, 0) : start] + text[stop : stop + 1]
    return not any(c.isascii() and c.isalpha() or "一" <= c <= "鿿" for c in around)


def model_annotate(text, entries, repeats=5):
    """Walk over the text once per term, longest first, and note the free places."""
    order = sorted(range(len(entries)), key=lambda i: (-len(entries[i][0]), i))
    for term, target in (entries[i][:2] for i in order):
        built, at, left = [], 0, repeats
        while left and (hit := text.find(term, at)) >= 0:
            stop = hit + len(term)
            if _stands_free(text, hit, stop):
                built.append(text[at:stop] + f"<{target}>")
                at, left = stop, left - 1
            else:
                built.append(text[at : hit + 1])
                at = hit + 1
        text = "".join(built) + text[at:]
    return text
