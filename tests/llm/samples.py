"""Made-up texts of the tests."""

import random

ALPHABET = ["a", "B", "the", "ing", " ", "  ", "\n", "\t", "é", "漢", "🙂", "'s", "123", "!!", "\x1c", "\x85", "\xa0", "und", "ß", "<|endoftext|>"]


def noise(seed, size):
    chosen = random.Random(seed)
    return "".join(chosen.choice(ALPHABET) for _ in range(size))


def prose(seed, size):
    chosen = random.Random(seed)
    return " ".join("".join(chosen.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(chosen.randint(1, 4))) for _ in range(size))
