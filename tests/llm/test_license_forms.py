"""Usual forms of licence statements, near misses, and the cosine against plain Python."""

from __future__ import annotations

import collections
import math
import re

from barlab.llm import license_texts as texts
from barlab.llm import licenses

GPL3 = texts.GNU_HEADER.format(name="GNU General Public License", version="3")
LGPL = texts.GNU_HEADER.format(name="GNU Lesser General Public License", version="2.1")


def commented(text: str, sign: str = " * ", width: int = 70) -> str:
    words, lines = text.split(), [""]
    for w in words:
        if len(lines[-1]) + len(w) > width:
            lines.append("")
        lines[-1] += f" {w}" if lines[-1] else w
    return "\n".join(sign + x for x in lines)


def source(header: str, sign: str = "// ") -> str:
    return f"{commented(header, sign)}\n\nint main() {{ return 0; }}\n// the end of a long way home\n"


FILES = {
    "LICENSE": (f"MIT License\n\nCopyright (c) 2021 Some Body\n\n{commented(texts.MIT, '')}\n", "MIT"),
    "bsd2/LICENSE": (f"Copyright (c) 2020, Some Body\nAll rights reserved.\n\n{texts.BSD_HEAD}\n\n{texts.BSD_TAIL}", "BSD-2-Clause"),
    "bsd3/LICENSE.txt": (f"Copyright 2020 Some Body\n\n{texts.BSD_HEAD}\n\n{texts.BSD_ENDORSE}\n\n{texts.BSD_TAIL}", "BSD-3-Clause"),
    "isc/LICENSE": (f"Copyright 2019 Some Body\n\n{texts.ISC}", "ISC"),
    "apache/LICENSE": ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS\n\n1. Definitions.", "Apache-2.0"),
    "gpl/COPYING": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy.\n\nPreamble", "GPL-3.0"),
    "mpl/LICENSE": ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "MPL-2.0"),
    "src/a.c": (source("Copyright 2020 Some Body. " + texts.MIT), "MIT"),
    "src/b.java": (f"/*\n * Copyright 2020 Some Body\n *\n{commented(texts.APACHE_HEADER)}\n */\npackage a;\n", "Apache-2.0"),
    "src/c.c": (source(GPL3), "GPL-3.0"),
    "src/d.py": (source(GPL3.replace("version 3", "version 2"), "# "), "GPL-2.0"),
    "src/e.c": (source(LGPL), "LGPL-2.1"),
    "src/f.js": (source(texts.MPL_HEADER), "MPL-2.0"),
    "src/g.rs": ("// SPDX-License-Identifier: MIT\nfn main() {}", "MIT"),
    "src/h.rs": ("# SPDX-License-Identifier: Apache-2.0\r\nx = 1", "Apache-2.0"),
    "src/i.c": ("/* SPDX-License-Identifier: GPL-2.0-only */\nint x;", "GPL-2.0"),
    "src/j.c": ("// SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    "doc/a.md": ("# Notes\n\nThis work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.\n", "CC-BY-SA-4.0"),
    "doc/b.md": ("Licensed under CC BY 4.0", "CC-BY-4.0"),
    # near misses
    "no/a.c": ("// SPDX-License-Identifier: Foo-1.0\nint x;", None),
    "no/b.md": ("Licensed under the Orchard License, Version 7.1", None),
    "no/c.md": ("The driving license and the copyright of the picture were lost on the way to the market.", None),
    "no/d.md": ("This work is licensed under the GNU General Public License, version 9", None),
    "no/e.md": (None, None),
}


def words(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


def test_forms_and_cosines(spark):
    rows = [(f"t/{path}", text) for path, (text, _) in FILES.items()] + [(f"u/{i}", f"plain prose of number {i}") for i in range(60)]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: got[f"t/{p}"].direct_license for p in FILES} == {p: lic for p, (_, lic) in FILES.items()}
    assert got["t/no/a.c"].license == "MIT"  # of the folder above
    assert all(got[f"u/{i}"].basis == "none" for i in range(60))

    # the cosine of one-line files once more
    docs = collections.Counter(w for _, t in rows for w in set(words(t)))
    def vector(text):
        v = {w: c * (math.log((len(rows) + 1) / (docs[w] + 1)) + 1) for w, c in collections.Counter(words(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    for path in ("src/j.c", "doc/b.md", "src/i.c", "src/g.rs"):
        units = [vector(x) for x in FILES[path][0].split("\n") + [FILES[path][0]] if x]
        best = max(
            sum(x * form.get(w, 0.0) for w, x in unit.items())
            for lic, text, _ in texts.statements() if lic == FILES[path][1] for form in [vector(text)] for unit in units
        )
        assert abs(got[f"t/{path}"].cosine - best) < 1e-5


def test_one_notice_in_a_third_of_all_files(spark):
    rows = [(f"p{i}/x.py", "Released under the MIT License" if i % 3 == 0 else f"text {i}", 1, "own") for i in range(300)]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string, cosine int, basis string")).collect()
    assert len(got) == 300 and sum(r.license == "MIT" for r in got) == 100
    assert all((r.license is None) == (r.basis == "none") for r in got)
