"""A command line for single files: python -m tessera.cli in.png out.png [options]."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from tessera.errors import Fault, UsageError, exit_code
from tessera.files import quantize_file
from tessera.functions import numbers
from tessera.plans import quantize as Q

VERSION = "0.2.0"
MOST_THREADS = 256
#: The options, and the words that each takes.
ON_OFF = ("off", "on")
HELP = """usage: tessera IN.png OUT.png [options]

  --colors N                 palette size, 1 to 256 (256)
  --colors-search MIN..MAX@Q fewest colours at a quality of 0 to 100
  --hidden-rgb-policy P      canonicalize-black or preserve-mean
  --color-space S            srgb or oklab
  --adaptive-default D       off, on or guarded (guarded)
  --dither D                 off or on
  --dither-strength S        a decimal between 0 and 1
  --dither-policy P          uniform, adaptive, region, adaptive-unit or luma-bluenoise
  --pack M                   none, fast or max
  --pack-search V            v1 or v2
  --pack-seam-palette-sort, --pack-seam-memlevel, --pack-seam-reduction  off or on
  --max-pixels N             most pixels of an image
  --threads N                accepted for 1 to 256; images run in parallel on a cluster instead
  --parallel-merge-order O   balanced, forward, reverse or shuffle:SEED; results never depend on it
  --report json              a report on one line
  --version, --help

The input's own bytes are written if the result isn't shorter.
Exit codes: 0 done, 2 usage, 3 data, 5 input or output, 70 internal.
"""
CHOICES = {
    "--hidden-rgb-policy": ("hidden", None), "--color-space": ("space", ("srgb", "oklab")), "--adaptive-default": ("adaptive", Q.DEFAULTS), "--dither": ("dither", ON_OFF),
    "--dither-policy": ("policy", Q.POLICIES), "--pack": ("pack", Q.MODES), "--pack-search": ("search", Q.SEARCHES), "--pack-seam-palette-sort": ("sort", ON_OFF),
    "--pack-seam-memlevel": ("memory", ON_OFF), "--pack-seam-reduction": ("reduction", ON_OFF), "--report": ("report", ("json",)),
}
OTHERS = ("--colors", "--colors-search", "--dither-strength", "--max-pixels", "--threads", "--parallel-merge-order")


def merge_order(text: str) -> tuple[str, int | None]:
    """An order in which partial results meet: its name, and the seed of a shuffle."""
    if text in ("balanced", "forward", "reverse"):
        return text, None
    name, colon, seed = text.partition(":")
    if name != "shuffle" or not colon or not (seed.removeprefix("+").isascii() and seed.removeprefix("+").isdecimal()) or int(seed) >= 1 << 64:
        raise UsageError("the merge order must be balanced, forward, reverse or shuffle:SEED")
    return name, int(seed)


def whole(name: str, text: str, least: int, most: int | None = None) -> int:
    value = numbers.integer(text)
    if value is None or value < least or most is not None and value > most:
        raise UsageError(f"{name} must be an integer of at least {least}" + (f" and at most {most}" if most else ""))
    return value


def value_of(name: str, text: str):
    if name == "--colors":
        value = numbers.integer(text)
        if value is None:
            raise UsageError("--colors must be an integer")
        return "colours", value
    if name == "--colors-search":
        try:
            return "fewest", Q.sizes(text)
        except Fault as e:
            raise UsageError(e.message) from None
    if name == "--dither-strength":
        return "strength", numbers.strength(text)
    if name == "--max-pixels":
        return "most_pixels", whole(name, text, 1)
    if name == "--threads":
        return "threads", whole(name, text, 1, MOST_THREADS)
    return "merge", merge_order(text)


def parse(argv: Sequence[str]) -> tuple[list[str], dict]:
    """Paths and options as given; refuses what isn't an option or has no value."""
    paths, got, rest = [], {}, list(argv)
    while rest:
        word = rest.pop(0)
        if not word.startswith("-"):
            paths.append(word)
            continue
        if word not in CHOICES and word not in OTHERS:
            raise UsageError(f"unknown option {word}")
        if not rest:
            raise UsageError(f"{word} needs a value")
        text = rest.pop(0)
        if word in OTHERS:
            key, value = value_of(word, text)
        else:
            key, words = CHOICES[word]
            if words and text not in words:
                raise UsageError(f"{word} must be one of {', '.join(words)}")
            value = text == "on" if words == ON_OFF else text
        got[key] = value
    return paths, got


def composed(got: dict) -> Q.Options:
    """The options, if they go together: what a library call refuses as data is usage here, but for the
    number of colours and the hidden policy, which it is left to refuse."""
    if got.get("adaptive", "guarded") != "off" and {"dither", "strength", "policy"} & set(got):
        raise UsageError(f"--adaptive-default {got.get('adaptive', 'guarded')} can't be combined with explicit dither options")
    if "search" in got and got.get("pack", "none") == "none":
        raise UsageError("--pack-search needs --pack fast or max")
    if "fewest" in got and "colours" in got:
        raise UsageError("--colors-search can't be combined with --colors")
    choice = {k: v for k, v in got.items() if k not in ("report", "threads", "merge")}
    late = {k: choice.pop(k) for k in ("colours", "hidden") if k in choice}
    if fault := Q.refused(choice):
        raise fault
    return Q.Options(**choice, **late)


def main(argv: Sequence[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if "--help" in argv:
        print(HELP, end="")
        return 0
    if "--version" in argv:
        print(f"tessera {VERSION}")
        return 0
    try:
        paths, got = parse(argv)
        options = composed(got)
        if len(paths) != 2:
            raise UsageError("usage: tessera IN.png OUT.png [options]")
        done = quantize_file(*paths, options)
    except Fault as e:
        print(f"{e.kind}_error: {e.message}", file=sys.stderr)
        return exit_code(e)
    told = done.summary()
    if "report" in got:
        print(told["report"])
        return 0
    print(f"tessera {VERSION}: {told['bytes_in']} -> {told['bytes_out']} bytes, {told['palette_entries']} palette entries ({done.notes.alpha_note})")
    if done.fallback:
        print(f"never-worse: encoded output ({done.encoded_bytes} bytes) >= input ({done.bytes_in} bytes); the input was written")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
