"""Natural-language queries: a protocol that fills unset parameters, a filler for language models, and fillers without a model.

``ModelFiller`` asks any model that completes a text. ``SlotFiller`` reads typed values off the words and chooses
the readings that explain most of the sentence; ``RuleFiller`` takes the first hit of a few plain rules.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from tesserine.plans.query import Param
from tesserine.schema import SchemaError


class ParamFiller(Protocol):
    def fill(self, text: str, params: list[Param]) -> dict[str, object]: ...


class RuleFiller:
    """Options that occur as words, numbers after a parameter's name or limit words, and weights from prefer / avoid / ignore."""

    LIMIT = re.compile(r"\b(?:top|first|best|limit)\s+(\d+)\b", re.I)

    def fill(self, text: str, params: list[Param]) -> dict[str, object]:
        low, out = text.lower(), {}
        for p in params:
            name = p.name.lower().removesuffix("_param__")
            words = [w for w in re.split(r"[_\W]+", name) if w and w not in ("weight", "param", "limit")]
            if p.options:
                hit = [o for o in p.options if re.search(rf"\b{re.escape(str(o).lower())}\b", low)]
                if hit:
                    out[p.name] = hit if isinstance(p.default, (list, tuple)) else hit[0]
            elif "weight" in name:
                for pattern, weight in ((r"(?:avoid|without|not|no|dislike)", -1.0), (r"(?:ignore|regardless of|any)", 0.0), (r"(?:prefer|important|like|by|with)", 1.0)):
                    if words and re.search(rf"\b{pattern}\s+(?:\w+\s+){{0,2}}{re.escape(words[0])}", low):
                        out[p.name] = weight
                        break
            elif "limit" in name and (m := self.LIMIT.search(text)):
                out[p.name] = int(m[1])
            elif words and (m := re.search(rf"\b{re.escape(' '.join(words))}\D{{0,15}}?(-?\d+(?:\.\d+)?)", low)):
                out[p.name] = float(m[1]) if "." in m[1] else int(m[1])
            elif re.search(r"(text|query|search)", name):
                out[p.name] = text
        return out


NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {"twenty": 20, "thirty": 30, "fifty": 50, "hundred": 100, "dozen": 12}
UNITS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "percent": 0.01, "%": 0.01}
TOKEN = re.compile(r"-?\d[\d,]*(?:\.\d+)?|[^\W\d_]+(?:[#&'-][^\W_]+|#\w+)*|[%<>]=?")
NOT = frozenset("not no except without excluding but never".split())
LIKED, DISLIKED, LEFT_OUT = frozenset("prefer important like love matters high care want emphasis".split()), frozenset("avoid dislike without hate less low against".split()), frozenset("ignore regardless whatever irrelevant".split())
#: What a number's neighbours say about a range: words before it that make it the lower or the upper end.
LOWER, UPPER = frozenset("over above least from min minimum more after > >=".split()), frozenset("under below most to max maximum up less until before within < <=".split())
LIMITS, THINGS = frozenset("top first best limit show".split()), frozenset("results items rows matches hits".split())


@dataclass(frozen=True)
class Reading:
    """A value of one parameter, the tokens that it explains, and how well."""

    name: str
    value: object
    start: int
    end: int
    worth: float


def near_words(a: str, b: str) -> bool:
    """Equal, or a typing mistake apart: one for words of five letters or more, two from nine on."""
    if a == b:
        return True
    most = 0 if min(len(a), len(b)) < 5 else 1 if min(len(a), len(b)) < 9 else 2
    if abs(len(a) - len(b)) > most or any(c.isdigit() for c in a + b):
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


class SlotFiller:
    """Fills parameters from typed values in a sentence, without a model.

    Every parameter proposes readings by its kind: options (with typing mistakes, not where a negation stands
    before them), weights from words of liking near its name (-1, 0 or 1), limits, and numbers with units
    near its name, where "over", "under" and "between" choose the parameter of the fitting end (names with
    min or max). The readings that together are worth most, overlap nowhere and give each parameter one value are
    taken. A text parameter gets the sentence.
    """

    def fill(self, text: str, params: list[Param]) -> dict[str, object]:
        tokens = TOKEN.findall(text.lower())
        readings = [r for p in params for r in self._readings(p, tokens)]
        out = {r.name: r.value for r in self._best(readings, len(tokens))}
        for p in params:
            if p.options and isinstance(p.default, (list, tuple)):
                many = [r.value for r in readings if r.name == p.name]
                if many:
                    out[p.name] = list(dict.fromkeys(many))
            elif p.name not in out and not p.options and re.search(r"(text|query|search)", p.name.lower()):
                out[p.name] = text
        return out

    @staticmethod
    def _best(readings: list[Reading], n: int) -> list[Reading]:
        """The readings of the greatest worth in total, none over another, one per parameter."""
        charts: list[dict[frozenset, tuple[float, tuple]]] = [{frozenset(): (0.0, ())}] + [{} for _ in range(n)]
        for at in range(n + 1):
            for used, (worth, taken) in list(charts[at].items()):
                steps = [(at + 1, used, worth, taken)] if at < n else []
                steps += [(r.end, used | {r.name}, worth + r.worth, (*taken, r)) for r in readings if r.start == at and r.name not in used]
                for end, names, total, chosen in steps:
                    if total > charts[end].get(names, (-1.0, ()))[0]:
                        charts[end][names] = (total, chosen)
        return list(max(charts[n].values(), key=lambda x: x[0])[1])

    @staticmethod
    def _number(tokens: list[str], i: int) -> tuple[float, int] | None:
        """A number at a token and the token behind it and its unit."""
        t = tokens[i].replace(",", "")
        if re.fullmatch(r"-?\d+(\.\d+)?", t):
            value = float(t)
        elif t in NUMBERS:
            value = float(NUMBERS[t])
        else:
            return None
        unit = UNITS.get(tokens[i + 1]) if i + 1 < len(tokens) else None
        return (value * unit, i + 2) if unit else (value, i + 1)

    def _readings(self, p: Param, tokens: list[str]) -> list[Reading]:
        name = p.name.lower().removesuffix("_param__")
        parts = [w for w in re.split(r"[_\W]+", name) if w]
        low, high = bool({"min", "minimum", "least", "from", "above"} & {*parts}), bool({"max", "maximum", "most", "to", "below"} & {*parts})
        words = [w for w in parts if w not in ("weight", "param", "limit", "min", "max", "minimum", "maximum", "least", "most", "from", "to", "above", "below")]
        named = [i for i, t in enumerate(tokens) if any(near_words(t, w) or near_words(t, w + "s") for w in words)]
        if p.options:
            return self._options(p, tokens)
        if "weight" in parts:
            out = []
            for i in named:
                lo = max(0, i - 3)
                for value, said in ((-1.0, DISLIKED), (0.0, LEFT_OUT), (1.0, LIKED)):
                    for k in [*range(lo, i), *range(i + 1, min(len(tokens), i + 3))]:
                        if tokens[k] in said:
                            turned = value > 0 and k and ({"not", "don't", "doesn't"} & {*tokens[max(0, k - 2) : k]})
                            out.append(Reading(p.name, -value if turned else value, min(k, i), max(k, i) + 1, 2.0 - 0.2 * abs(k - i)))
            return out
        numbers = [(i, *found) for i in range(len(tokens)) if (found := self._number(tokens, i))]
        out = []
        for i, value, end in numbers:
            value = int(value) if value == int(value) else value
            before, after = tokens[max(0, i - 2) : i], tokens[end : end + 2]
            if "limit" in parts:
                if before[-1:] and before[-1] in LIMITS or after[:1] and after[0] in THINGS:
                    start = i - 1 if before[-1:] and before[-1] in LIMITS else i
                    out.append(Reading(p.name, value, start, end + (1 if after[:1] and after[0] in THINGS else 0), 3.0))
                continue
            far = min((abs(i - k) for k in named), default=9)
            if far > 6:
                continue
            lower, upper = bool(LOWER & {*before}), bool(UPPER & {*before})
            pair = "between" in tokens[max(0, i - 3) : i]
            if pair and i and tokens[i - 1] != "and":
                lower = True
            elif tokens[max(0, i - 1)] in ("and", "to") and any(n[0] < i and "between" in tokens[max(0, n[0] - 2) : n[0]] or n[2] == i - 1 for n in numbers):
                upper, lower = True, False
            if low and upper and not lower or high and lower and not upper:
                continue
            fits = 1.0 if low and lower or high and upper or not (low or high) else 0.3
            out.append(Reading(p.name, value, i, end, 1.0 + fits - 0.15 * far))
        return out

    @staticmethod
    def _options(p: Param, tokens: list[str]) -> list[Reading]:
        out = []
        for option in p.options:
            words = TOKEN.findall(str(option).lower())
            for i in range(len(tokens) - len(words) + 1):
                if words and all(near_words(t, w) for t, w in zip(tokens[i:], words)) and not NOT & {*tokens[max(0, i - 2) : i]}:
                    exact = tokens[i : i + len(words)] == words
                    out.append(Reading(p.name, option, i, i + len(words), 2.0 * len(words) + exact))
        return out


class ModelFiller:
    """Asks a language model for the unset parameters and checks its answer.

    ``complete`` takes a prompt and returns text with one JSON object in it. Weights must be -1, 0 or 1,
    parameters with options one of them (or a list of them where the default is a list), and
    names must be asked for; null leaves a parameter unset. A wrong answer is sent back with what is
    wrong, ``tries`` times in all.
    """

    WEIGHTS = (-1, 0, 1)

    def __init__(self, complete: Callable[[str], str], system_prompt: str = "", tries: int = 3):
        self.complete, self.system_prompt, self.tries = complete, system_prompt, tries

    @staticmethod
    def _is_weight(p: Param) -> bool:
        return "weight" in p.name.lower()

    def prompt(self, text: str, params: list[Param]) -> str:
        lines = [self.system_prompt, "Fill the parameters of a search from the user's words. Answer with one JSON object; null where the words say nothing."]
        for p in params:
            of = list(self.WEIGHTS) if self._is_weight(p) else p.options
            lines.append(f"- {p.name}" + (f": {p.description}" if p.description else "") + (f" (one of {json.dumps(list(of))})" if of else ""))
        return "\n".join([*filter(None, lines), f"User: {text}"])

    def _checked(self, answer: str, params: list[Param]) -> dict[str, object]:
        if not (m := re.search(r"\{.*\}", answer, re.S)):
            raise SchemaError("the answer holds no JSON object")
        try:
            given = json.loads(m[0])
        except ValueError as e:
            raise SchemaError(f"the answer is no JSON: {e}") from e
        known, out = {p.name: p for p in params}, {}
        for name, value in given.items():
            if name not in known:
                raise SchemaError(f"{name} was not asked for")
            if value is None:
                continue
            if self._is_weight(known[name]) and value not in self.WEIGHTS:
                raise SchemaError(f"{name} must be one of {self.WEIGHTS}")
            out[name] = known[name].check(value)
        return out

    def fill(self, text: str, params: list[Param]) -> dict[str, object]:
        prompt, wrong = self.prompt(text, params), None
        for _ in range(self.tries):
            try:
                return self._checked(self.complete(prompt if wrong is None else f"{prompt}\nThe last answer was wrong: {wrong}"), params)
            except SchemaError as e:
                wrong = e
        raise SchemaError(f"no usable answer after {self.tries} tries: {wrong}")
