"""Members of zip archives."""

from __future__ import annotations

import zipfile
from pathlib import Path


def pick_member(names: list[str], target: str, member: str = "") -> str:
    """The given member, or the only file, or the file named like the target; anything else is a ValueError."""
    files = [n for n in names if not n.endswith("/")]
    if member:
        if member not in names:
            raise ValueError(f"no member {member!r}; there are {files}")
        return member
    if len(files) == 1:
        return files[0]
    same = [n for n in files if Path(n).name == target]
    if not same:
        raise ValueError(f"which member? there are {files}")
    return same[0]


def unpack_member(archive: str, output: str, member: str = "", force: bool = False) -> dict:
    """Extracts one member to output, in pieces. A target that exists stays unless forced. Returns status (exists or
    written), member, output and bytes; for a target that exists member is the argument."""
    target = Path(output)
    if target.exists() and not force:
        return {"status": "exists", "member": member, "output": str(target), "bytes": target.stat().st_size}
    with zipfile.ZipFile(archive) as z:
        name = pick_member(z.namelist(), target.name, member)
        target.parent.mkdir(parents=True, exist_ok=True)
        with z.open(name) as source, target.open("wb") as sink:
            while piece := source.read(1 << 20):
                sink.write(piece)
    return {"status": "written", "member": name, "output": str(target), "bytes": target.stat().st_size}
