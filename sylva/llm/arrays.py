"""SQL over the arrays of one row whose cost grows in proportion to the array, but for sorting.

A fold that appends to its result copies it at every step.  Running values are therefore taken in blocks, and those of the
blocks' totals in blocks again.
"""

from __future__ import annotations

from collections.abc import Callable

BLOCK, LEVELS = 32, 3

Step = Callable[[str, str], str]
PLUS: Step = "{0} + {1}".format
MOST: Step = "greatest({0}, {1})".format
LEAST: Step = "least({0}, {1})".format


def let(name: str, value: str, body: str) -> str:
    """SQL of body, in which name stands for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _short(x: str, step: Step, zero: str) -> str:
    return f"""aggregate({x}, cast(struct({zero}, array()) as struct<a: int, o: array<int>>),
      (acc, v) -> struct({step('acc.a', 'v')} as a, concat(acc.o, array(acc.a)) as o), acc -> acc.o)"""


def running(x: str, step: Step = PLUS, zero: str = "0", level: int = LEVELS) -> str:
    """SQL of an array of ints: at each place of the array of ints x (a name), zero and all elements before it, combined."""
    if level == 0:
        return _short(x, step, zero)
    blocks = f"transform(sequence(0, (size({x}) - 1) div {BLOCK}), b -> slice({x}, b * {BLOCK} + 1, {BLOCK}))"
    totals = f"transform(x{level}, y -> aggregate(y, {zero}, (a, v) -> {step('a', 'v')}))"
    parts = f"flatten(zip_with(x{level}, {running(f't{level}', step, zero, level - 1)}, (y, z) -> {_short('y', step, 'z')}))"
    return let(f"x{level}", blocks, let(f"t{level}", totals, parts))


def apart(spans: str, others: str) -> str:
    """SQL of those of the spans (a name; structs with s and e) that overlap none of the others (a name)."""
    both = f"""array_sort(concat(transform({others}, o -> struct(o.s as s, o.e as e, -1 as i)),
      transform({spans}, (c, i) -> struct(c.s as s, c.e as e, i as i))))"""
    ends = "transform(both, c -> if(c.i < 0, c.e, 0))"
    starts = "reverse(transform(both, c -> if(c.i < 0, c.s, 2147483647)))"
    kept = f"transform(filter(transform(both, (c, k) -> struct(c.i as i, c.i >= 0 and ended[k] <= c.s and begins[k] >= c.e as free)), c -> c.free), c -> {spans}[c.i])"
    kept = let("starts", starts, let("begins", f"reverse({running('starts', LEAST, '2147483647')})", kept))
    kept = let("both", both, let("ends", ends, let("ended", running("ends", MOST), kept)))
    return f"if(size({spans}) = 0 or size({others}) = 0, {spans}, {kept})"


#: Code points of a piece of a text that is cut at once.
PIECE = 512


def pieces(text: str) -> str:
    """SQL of the text in pieces, from which cut() takes spans without walking through the text each time."""
    return f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"


def cut(text: str, start: str, end: str) -> str:
    """SQL of the code points from start to end of a text, given as its pieces (a name)."""
    one = f"substring({text}[k], greatest({start} - k * {PIECE}, 0) + 1, least({end} - k * {PIECE}, {PIECE}) - greatest({start} - k * {PIECE}, 0))"
    return f"if({end} <= {start}, '', array_join(transform(sequence({start} div {PIECE}, ({end} - 1) div {PIECE}), k -> {one}), ''))"
