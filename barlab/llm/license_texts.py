"""Licence statements to recognise: full texts of short licences, standard headers, titles, identifiers."""

from __future__ import annotations

# Wording of the licences as their publishers give it.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""
GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see
<https://www.gnu.org/licenses/>."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: Licence, statement, and the terms that a unit must hold to be taken for it.
Statement = tuple[str, str, str]


def _gnu() -> list[Statement]:
    out = []
    for short, name, must, versions in (
        ("GPL", "GNU General Public License", "general", {"2": ("2.0", "June 1991"), "3": ("3.0", "29 June 2007")}),
        ("LGPL", "GNU Lesser General Public License", "lesser", {"2.1": ("2.1", "February 1999"), "3": ("3.0", "29 June 2007")}),
        ("AGPL", "GNU Affero General Public License", "affero", {"3": ("3.0", "19 November 2007")}),
    ):
        for version, (full, date) in versions.items():
            license, needed = f"{short}-{full}", f"{must} {version}"
            header = GNU_HEADER.format(name=name, version=version)
            first, *_ = header.split(" This program is distributed")
            out += [(license, text, needed) for text in (
                header, first, f"{name} Version {version}, {date}", f"This work is licensed under the {name}, version {version}",
            )]
            spdx = f"spdx {short} {version}"
            out += [(license, f"SPDX-License-Identifier: {license}{end}", spdx) for end in ("", "-only", "-or-later")]
    return out


def statements() -> list[Statement]:
    """Every statement to compare with."""
    names = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}
    bodies = {
        "MIT": (MIT, "merge sublicense"), "ISC": (ISC, "fee granted"), "BSD-2-Clause": (f"{BSD_HEAD} {BSD_TAIL}", "redistribution binary"),
        "BSD-3-Clause": (f"{BSD_HEAD} {BSD_ENDORSE} {BSD_TAIL}", "redistribution binary endorse"),
    }
    out = [(license, text, must) for license, (text, must) in bodies.items()]
    out += [(license, f"{names[license]} Copyright (c) {text}", must) for license, (text, must) in bodies.items()]
    out += [(license, name, name) for license, name in names.items()]
    out += [(license, f"Released under the {name}", name) for license, name in names.items()]
    out += [
        ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD License", "bsd"),
        ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "bsd"),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
        ("Apache-2.0", APACHE_HEADER, "apache 2"),
        ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "apache 2"),
        ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0", "mozilla 2"),
        ("MPL-2.0", MPL_HEADER, "mozilla 2"),
        ("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla 2"),
    ]
    for parts in ("", "SA", "ND", "NC", "NC SA", "NC ND"):
        license = "-".join(["CC-BY", *parts.split(), "4.0"])
        short = "-".join(["CC BY", *parts.split()])
        words = {"SA": "ShareAlike", "ND": "NoDerivatives", "NC": "NonCommercial"}
        long = "-".join(["Attribution", *(words[p] for p in parts.split())])
        name = f"Creative Commons {long} 4.0 International License"
        path = short.removeprefix("CC ").lower()
        out += [
            (license, f"Licensed under {short} 4.0", f"cc by {parts} 4"), (license, f"This work is licensed under a {name}", f"creative commons 4 {long}"),
            (license, f"This work is licensed under a {name}. To view a copy of this license, visit http://creativecommons.org/licenses/{path}/4.0/", f"commons 4 {long}"),
        ]
    spdx = ["MIT", "MIT-0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "0BSD", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
    out += [(license, f"SPDX-License-Identifier: {license}", f"spdx {license}") for license in spdx]
    return out + _gnu()
