"""What is known of a file without a recogniser: its text from files beside it, its size in pixels from its header."""

from __future__ import annotations

import json
import os
import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

READ = "struct<text:string,ocr_json:string,width:int,height:int,error:string>"


def dimensions(head: bytes) -> tuple[int | None, int | None]:
    """Width and height by the headers of PNG, GIF and BMP files; none for others."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return abs(w), abs(h)
    return None, None


def read_beside(path: str) -> dict:
    """A file's text: recognised lines in ``path.json`` (a list of lines with text and words), else ``path.txt`` or the same name with .txt.

    Without either the text is empty; a file, or a JSON file beside it, that can't be read gives an error.
    """
    out: dict = {"text": "", "ocr_json": None, "width": None, "height": None, "error": None}
    try:
        with open(path, "rb") as f:
            out["width"], out["height"] = dimensions(f.read(32))
        if os.path.exists(path + ".json"):
            with open(path + ".json", encoding="utf-8") as f:
                lines = json.load(f)
            out["text"] = "\n".join(x.get("text", x.get("Text", "")) for x in lines)
            out["ocr_json"] = json.dumps(lines, ensure_ascii=False)
        else:
            for beside in (path + ".txt", os.path.splitext(path)[0] + ".txt"):
                if os.path.exists(beside):
                    with open(beside, encoding="utf-8", errors="replace") as f:
                        out["text"] = f.read()
                    break
    except Exception as e:
        out |= {"text": "", "ocr_json": None, "error": f"{type(e).__name__}: {e}"}
    return out


def read_files(path: Column) -> Column:
    """:func:`read_beside` for a column of paths, as a struct of READ."""
    kind = pa.struct([("text", pa.string()), ("ocr_json", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("error", pa.string())])

    @F.arrow_udf(READ)
    def run(paths: pa.Array) -> pa.Array:
        return pa.array([read_beside(p) for p in paths.to_pylist()], kind)

    return run(path)


def there(path: str) -> bool:
    """Whether a file is there, or can't be told to be gone because its drive is not."""
    if os.path.exists(path):
        return True
    drive = os.path.splitdrive(path)[0]
    top = drive + os.sep if drive else os.sep.join(path.split(os.sep)[:2])
    return not os.path.isdir(top)


def on_disk(path: Column) -> Column:
    """:func:`there` for a column of paths."""

    @F.arrow_udf("boolean")
    def run(paths: pa.Array) -> pa.Array:
        return pa.array([p is not None and there(p) for p in paths.to_pylist()])

    return run(path)
