"""Single files: read, packed, and published at once."""

from __future__ import annotations

import contextlib
import os
import stat
import tempfile
from pathlib import Path

from tessera.errors import IoError
from tessera.plans.quantize import Options, Result, quantise
from tessera.sources import png


def mode_for(target: Path) -> int | None:
    """Permissions of the file there, or of the file that a link there points to; None without one."""
    try:
        if target.is_symlink() and target.exists() and not target.is_file():
            raise IoError(f"cannot write {target}: the link doesn't point to a file")
        return stat.S_IMODE(target.stat().st_mode) if target.is_file() else None
    except OSError as e:
        raise IoError(f"cannot write {target}: {e.strerror or e}") from None


def publish(target: str | os.PathLike, content: bytes) -> None:
    """Put a file in place by one rename, with the permissions of the one it replaces.

    The bytes go to a file beside it first, which is removed if anything fails; a link is replaced and
    not written through.
    """
    target = Path(target)
    mode, staged = mode_for(target), None
    try:
        handle, staged = tempfile.mkstemp(prefix=".tessera-", suffix=".tmp", dir=target.parent)
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        if mode is None:
            mask = os.umask(0)
            os.umask(mask)
            mode = 0o666 & ~mask
        os.chmod(staged, mode)
        os.replace(staged, target)
    except OSError as e:
        if staged:
            with contextlib.suppress(OSError):
                os.unlink(staged)
        raise IoError(f"cannot write {target}: {e.strerror}") from None


def quantize_file(source: str, target: str, options: Options = Options()) -> Result:  # noqa: B008
    """Pack one file into another, which may be the same."""
    got = quantise(png.read_file(source), options)
    publish(target, got.content)
    return got
