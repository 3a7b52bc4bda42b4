"""The pipeline's first three decisions by brute force."""

from gridspark.llm.common import words


def survivors(docs, items):
    kept = sorted(((d.doc_id, d.text) for d in docs if d.text and any(c.isalpha() for c in d.text)), key=lambda x: x[0])
    sets, label = [], {}
    for i, text in kept:
        w = words(text)
        own = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else None
        label[i] = {i}
        for j, other in sets:
            if own and other and len(own & other) >= 0.8 * len(own | other) - 1e-9 and label[i] is not label[j]:
                label[j] |= label[i]
                for x in label[i]:
                    label[x] = label[j]
        sets.append((i, own))
    leaks = [f" {' '.join(words(x.text))} " for x in items if x.text]
    return {i for i, text in kept if i == min(label[i]) and not any(x in f" {' '.join(words(text))} " for x in leaks)}
