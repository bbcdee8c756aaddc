"""The ordered scan for duplicates as plain code, item by item."""

from difflib import SequenceMatcher


def alike_titles(new, old, least=0.75):
    if SequenceMatcher(None, new["norm"], old["norm"]).ratio() < least:
        return False
    a, b = set(new["places"]), set(old["places"])
    return not (a and b and a.isdisjoint(b))


def better(new, old):
    quality = lambda x: (x["score"] or 0, bool(x["article_text"]), bool(x["image_url"]), len(x["article_text"] or ""))
    return quality(new) > quality(old)


def scan(rows, same_event, titles=alike_titles):
    """(ordinal, ground, slot, other, takes_over) of rows, which are visited in order of their ordinals."""
    standing, seen, out = {}, set(), []
    for new in sorted(rows, key=lambda r: r["ordinal"]):
        if new["url"] in seen:
            out.append((new["ordinal"], "url", None, None, False))
            continue
        for slot, old in standing.items():
            if titles(new, old):
                out.append((new["ordinal"], "title", slot, old["ordinal"], False))
                break
            if same_event(new, old):
                out.append((new["ordinal"], "event", slot, old["ordinal"], better(new, old)))
                seen.add(new["url"])
                if better(new, old):
                    standing[slot] = new
                break
        else:
            out.append((new["ordinal"], None, new["ordinal"], None, False))
            standing[new["ordinal"]] = new
            seen.add(new["url"])
    return out
