"""Code blocks of every shape against a line-by-line machine."""

import random

import pytest

from gitstrata.operators import blocks
from gitstrata.rules import blocks as rules


def by_machine(content, language):
    """``(first line, text)`` of each complete block, found line by line."""
    rule = next((r for r in rules.BLOCKS if language in r.languages), rules.REST)
    left, right = rule.brackets
    now, tags, out = None, [], []

    def opening(line, text):
        if rule.languages == rules.STYLE_SHEETS:
            return "{" in text and not text.startswith(rules.STYLE_RULE)
        text = text.lower() if rule.shape in ("budget", "tag") else text
        if rule.languages[:1] == ["Lua"]:
            return text.startswith("function ") or " function(" in text
        found = any(text.startswith(w) if rule.at_front else w in text for w in rule.starts)
        return found and not (rule.languages == rules.AT_MARGIN and line[:1].isspace())

    def close():
        code = "\n".join(now["lines"])
        if len(code) > rules.MIN_BLOCK:
            out.append((now["n"], code))

    for n, line in enumerate(content.split("\n"), 1):
        text = line.strip().upper() if rule.shape == "statement" else line.strip()
        indent = len(line) - len(line.lstrip())
        if rule.shape != "budget" and (not text or text.startswith(tuple(rule.comments))):
            continue
        if opening(line, text):
            if rule.languages == rules.WITH_DECLARATIONS and "{" not in text and ";" in text:
                continue
            if now:
                close()
            now = {"n": n, "lines": [line], "indent": indent, "open": text.count(left) - text.count(right)}
            tags += [t for t in rules.MARKUP_TAGS if rule.shape == "tag" and f"<{t}" in text.lower()][:1]
            continue
        if now is None:
            continue
        if rule.shape == "indent" and indent <= now["indent"]:
            close()
            now = None
            continue
        now["lines"].append(line)
        now["open"] += text.count(left) - text.count(right)
        done = False
        if rule.shape == "counter":
            done = now["open"] <= 0 or text in rule.ends
        elif rule.shape == "budget":
            done = len(now["lines"]) > rule.lines
        elif rule.shape == "end":
            done = text in rule.ends
        elif rule.shape == "end_indent":
            done = text in rule.ends and indent <= now["indent"]
        elif rule.shape == "statement":
            done = text.endswith(";") or "END" in text
        elif rule.shape == "tag" and tags and f"</{tags[-1]}>" in text.lower():
            tags.pop()
            done = not tags
        if done:
            close()
            now = None
    return out


def texts(language, rng):
    rule = next((r for r in rules.BLOCKS if language in r.languages), rules.REST)
    tags = [f"<{t}>" for t in rules.MARKUP_TAGS] + [f"</{t}>" for t in rules.MARKUP_TAGS]
    words = [*rule.starts, *rule.comments, *rule.ends, *rule.brackets, "{", "}", "(", ")", ";", "end", ":", "END", "@media", "é ", "value = 1", "long words to fill a line with text"]
    words += tags * (rule.shape == "tag")
    for _ in range(30):
        lines = []
        for _ in range(rng.choice([0, 1, 4, 15, 60])):
            part = [rng.choice(words) for _ in range(rng.choice([0, 1, 1, 1, 2, 4]))]
            lines.append(rng.choice(["", "", "  ", "\t", "    "]) + rng.choice(["", " "]).join(part) + rng.choice(["", "", " ", "\r"]))
        yield "\n".join(lines)


def test_blocks_agree_with_the_machine(spark):
    rng = random.Random(11)
    languages = [language for rule in rules.BLOCKS for language in rule.languages[:1]] + ["Other", None]
    rows = [(f"r{k}", str(i), language, text) for k, language in enumerate(languages) for i, text in enumerate(texts(language, rng))]
    files = spark.createDataFrame([*rows, ("r", "none", "Go", None)], "repository_id string, path string, language string, content string")
    got = sorted((r.repository_id, r.path, r.start_line, r.code) for r in blocks.code_blocks(files).collect())
    want = sorted((repository, path, n, code) for repository, path, language, text in rows for n, code in by_machine(text, language))
    assert got == want
    assert len({r[0] for r in want}) == len(languages)


@pytest.mark.parametrize("language", ["Python", "JavaScript", "Ruby", "HTML", "Other"])
def test_blocks_of_long_texts(spark, language):
    rng = random.Random(5)
    text = "\n".join(t for _ in range(8) for t in texts(language, rng))
    files = spark.createDataFrame([("r", "a", language, text), ("r", "b", language, "")], "repository_id string, path string, language string, content string")
    assert sorted((r.start_line, r.code) for r in blocks.code_blocks(files).collect()) == sorted(by_machine(text, language))
