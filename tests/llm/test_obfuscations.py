import random

import pyarrow as pa

from pagelens.llm import toxicity

CLEAN = "hello idle stop clean click lick the with and people think other some hint bits this pass small".split()
BAD = "idiot shit ass asshole stupid vermin".split()


def letters():
    counts = {}
    for word in CLEAN + BAD * 2:
        padded = f"^^{word}^"
        for i in range(len(padded) - 2):
            counts[padded[i : i + 3]] = counts.get(padded[i : i + 3], 0) + 50
    return toxicity.LetterModel(counts)


def test_every_promised_spelling_enters_the_lattice():
    model = letters()
    forms = {"5h17": "shit", "455h0l3": "asshole", "!diot": "idiot", "sh!+": "shit", "a$$": "ass", "st" + "u" * 60 + "pid": "stupid", "1d10t": "idiot", "(idiot)": "idiot", "!diot!!!": "idiot", "v.3.r.m.1.n": "vermin"}
    for form, word in forms.items():
        assert toxicity.restore(f"the {form} with", model) == f"the {word} with", form
    for plain in ("hello!", "stop!!!", "(lick", "(click)", "<clean", "2023", "think|"):
        assert toxicity.restore(plain, model) == "".join(c for c in plain if c.isalpha()), plain


def test_long_runs_of_spaced_letters_are_not_cut():
    model, rng = letters(), random.Random(2)
    words = [rng.choice(BAD[:2] + ["vermin", "people"]) for _ in range(300)]
    read = toxicity.restore(" ".join("".join(words)), model)
    assert read.replace(" ", "") == "".join(words)
    # What is read does not depend on where in the run a word stands.
    short = " ".join(toxicity.decode("".join(words[i : i + 30]), model, breaks=True) for i in range(0, 300, 30))
    assert abs(read.split().count("vermin") - short.split().count("vermin")) <= 10
    assert toxicity.restore("x1" * 4000, model)


def test_parts_compounds_and_long_words_are_features():
    model = letters()
    read = lambda text: [t for t in toxicity.Restorer(model.counts).readings(pa.array([text])).all if t]
    assert read("you/1diot") == ["youidiot", "you", "idiot"] and read("clean-idiot.") == ["cleanidiot", "clean", "idiot"]
    assert "vermin" in read("v-e-r-m-i-n") and read("don't") == ["dont"]
    assert {"漢字仮名", "字仮名混", "仮名混り", "名混り文"} <= set(read("漢字仮名混り文"))
    long, other = "a" + "bc" * 300, "a" + "bc" * 299 + "bd"
    hashes, owners = toxicity.features([long, other, "abcb"])
    assert owners.tolist().count(0) == owners.tolist().count(1) == 12
    whole = hashes[-3:]
    assert whole[0] != whole[1] and len(set(hashes.tolist())) < len(hashes)


def test_decoding_matches_every_path():
    from itertools import product

    model = letters()

    def paths(written):
        """Every reading with its worth, by trying all arcs."""
        arcs = []
        for i, c in enumerate(written):
            own = [(x, toxicity.SIGN_COST) for x in toxicity.LOOKALIKES.get(c, "")]
            again = i > 0 and written[i - 1] == c
            if c.isalpha():
                own += [(c, 0.0)] + ([("", toxicity.REPEAT_COST)] if again else [])
            else:
                own.append(("", toxicity.REPEAT_COST if again else toxicity.SEPARATOR_COST if c in toxicity.SEPARATORS else 2 * toxicity.NOISE_COST if c in toxicity.LOOKALIKES else toxicity.NOISE_COST))
            arcs.append(own)
        for choice in product(*arcs):
            word = "".join(x for x, _ in choice)
            if any(word[i] == word[i + 1] == word[i + 2] for i in range(len(word) - 2)):
                continue
            padded = "^^" + word + ("^" if word else "")
            worth = -sum(c for _, c in choice) + toxicity.LETTER_GAIN * len(word) + sum(model.log(*padded[i : i + 3]) for i in range(len(padded) - 2))
            yield worth, word

    for written in ("1d1ot", "st.u.p1d", "ve-rm1n", "h3ll0", "a55h0le", "cl1ckk", "id!ot5", "p30ple", "x9z"):
        best = max(paths(written))
        got = toxicity.decode(written, model)
        assert got == best[1] or abs(max(w for w, t in paths(written) if t == got) - best[0]) < 1e-9, written
