"""Licence texts by canonical digest.

A text is brought to a canonical form: lower case, copyright lines out, equivalent spellings made one, everything but
letters and digits a single space. The SHA-256 of that form is looked up in a table of known licences by a hash join, so
two texts match when they are the same licence, whatever its layout, punctuation, holder or year. The whole text is
looked up, and each whole line and paragraph as well, for notices such as "Released under the MIT License." and standard
headers, however they are wrapped; empty lines and copyright lines end a paragraph. A line that begins a copyright
statement is taken out; one that goes on with a word of ``NOT_HOLDERS`` is a wrapped line of a text and stays.

The known table has some thousand rows (``KNOWN_BOUND`` at most, which is checked), so it is broadcast; the documents are not
shuffled. All steps are SQL expressions. Long texts are files in ``licenses``, read by the driver. A GNU licence has one
name for its "only" and "or later" forms.

Edge cases: a NULL or empty text, or one of copyright lines only, has the digest of the empty form, which is no licence.
Repeated rows are scanned alike. Input columns with the name of a result are replaced.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strayfield.llm.common import fresh, let, replace
from strayfield.session import cut_lineage

KNOWN_BOUND = 10_000

# Equivalent spellings, the first becoming the second.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("copyright holder", "copyright owner"),
    ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("favour", "favor"),
    ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("while", "whilst"), ("https", "http"), ("v", "version"),
)

# Short licence texts and common notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

"""
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.

"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
TEXTS = (
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT), ("ISC", ISC + ISC_WARRANTY), ("ISC", "ISC License\n\n" + ISC + ISC_WARRANTY),
    ("0BSD", ISC.split(", provided")[0] + ".\n\n" + ISC_WARRANTY), ("BSD-2-Clause", BSD_HEAD + BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL), ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB),
)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License v3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
)

FILES = ("Apache-2.0", "Artistic-1.0", "BSD-3-Clause", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")
ADDRESS = re.compile(r"51 Franklin (?:St|Street), Fifth Floor, Boston,? MA\s+02110-1301,?\s+USA")
ADDRESSES = (
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
    "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA",
)
TO_FSF = re.compile(r"write to the Free\s+Software\s+Foundation,\s+Inc\.,\s+" + ADDRESS.pattern)
END = re.compile(r"END OF TERMS AND CONDITIONS")

# SPDX ids that are names here, and what notices call these licences.
CALLED = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache Software License, Version 2.0", "Apache-2.0 License", "Apache-2.0", "Apache License v2.0"),
    "MIT": ("MIT License", "MIT", "MIT/X11 License", "MIT License (MIT)"), "ISC": ("ISC License", "ISC"), "0BSD": ("Zero-Clause BSD License", "0BSD"), "Zlib": ("zlib License", "zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause License", "BSD-3-Clause"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"), "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "EPL-1.0": ("Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "Eclipse Public License - v 1.0", "EPL 1.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "EPL 2.0", "EPL-2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"), "Unlicense": ("Unlicense",), "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal", "CC0"),
    "Artistic-1.0": ("Artistic License 1.0",), "Artistic-2.0": ("Artistic License 2.0",), "GFDL-1.2": ("GNU Free Documentation License, Version 1.2",), "GFDL-1.3": ("GNU Free Documentation License, Version 1.3",),
}
for _name, _of, _short, _versions in (
    ("GPL", "General Public License", "GNU GPL", ("1", "2", "3")), ("LGPL", "Lesser General Public License", "GNU LGPL", ("2.1", "3")), ("AGPL", "Affero General Public License", "GNU AGPL", ("3",))
):
    for _v in _versions:
        _forms = {_v, f"{_v}.0"} if len(_v) == 1 else {_v}
        CALLED[f"{_name}-{max(_forms, key=len)}"] = tuple(
            c for v in sorted(_forms) for n in (f"GNU {_of}", _of, _short, _name) for c in (f"{n}, version {v}", f"{n} v{v}", f"{n}v{v}", f"{n} {v}", f"{n}-{v}", f"{n}, version {v} or later", f"{n} v{v} or later", f"{n} v{v}+")
        )
for _terms, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v, _port in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        CALLED[f"CC-{_terms}-{_v}"] = (
            f"CC {_terms} {_v}", f"CC-{_terms} {_v}", f"CC-{_terms}-{_v}", f"CC {_terms} {_v} {_port}", f"Creative Commons {_long} {_v}", f"Creative Commons {_long} {_v} {_port}", f"Creative Commons {_long} {_v} {_port} Public"
        )
UNDER = (  # what a notice says before the name of a licence, in canonical form
    r"^(?:spdx license identifier|license|(?:(?:this|the) [a-z]+(?: [a-z]+)? (?:is |are )?|all [a-z]+ (?:is |are )?|(?:text|content|code|source code) (?:is |are )?)?(?:dual )?"
    r"(?:licensed|released|distributed|available|published|made available|provided|covered)(?: under| by)(?: the)?(?: terms of)?(?: the| an?)?) "
)
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'), ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"), ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0.txt"), ("Apache-2.0", 'under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-1.0", "http://www.eclipse.org/legal/epl-v10.html"), ("EPL-2.0", "http://www.eclipse.org/legal/epl-2.0"), ("EPL-2.0", "http://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."), ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
]
for _name, _of, _versions in (("GPL", "General Public License", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",))):
    for _v in _versions:
        for _what, _free in ((w, f) for w in ("program", "library", "software", "file") for f in (":", ";")):
            _head = f"This {_what} is free software{_free} you can redistribute it and/or modify it under the terms of the GNU {_of} as published by the Free Software Foundation"
            _id, _n = f"{_name}-{_v}", _v.removesuffix(".0")
            HEADERS += [(_id, f"{_head}{x}") for x in (f", either version {_n} of the License, or (at your option) any later version.", f"; either version {_n} of the License, or (at your option) any later version.", f", version {_n} of the License.", f"; version {_n} of the License.", f"; version {_n}.", f" version {_n}.")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_HOLDERS = (
    "holders? notices? and laws? owners? owned ownership line disclaimers? interests? resulting permissions? on licen[sc]es? licen[sc]ed treat(?:y|ies) those statements? patents? or of like if doctrines are also conventions? including more is in to for as"
    " protection acts? infringement rights? materials? works? information claims? violations? that which this with without from may shall will can under the(?=[^a-z0-9]+(?:software|library|program|work)(?![a-z0-9]))"
).replace(" ", "|")
COPYRIGHT = (
    r"(?m)^[^a-z0-9\n]*(?:(?:(?:some |other )?(?:portions|parts|modifications|changes|additions)(?: of (?:this|the) [a-z]+)?(?: are| is)?[^a-z0-9\n]+)?"
    r"copyright(?![a-z0-9])(?:[^a-z0-9\n]*[©぀-鿿]|[^a-z0-9\n]*(?=[a-z0-9])(?!(?:" + NOT_HOLDERS + r")(?![a-z0-9])))"
    r"|\(c\) ?[0-9]|\(c\)[^\n]{0,80}(?:19|20)[0-9][0-9]|©|all rights reserved)[^\n]*$"
)


def long_texts() -> list[tuple[str, str]]:
    """The texts in ``licenses``: whole, and up to the end of their terms; GNU ones with each address they were given out with."""
    out, folder = [], resources.files("strayfield.llm") / "licenses"
    for name in FILES:
        text = (folder / f"{name}.txt").read_text(encoding="utf-8")
        forms = [text]
        if ADDRESS.search(text):
            forms += [ADDRESS.sub(a, text) for a in ADDRESSES]
            forms.append(ADDRESS.sub("", TO_FSF.sub("see <http://www.gnu.org/licenses/>", text)))
        if name.startswith("CC-BY"):
            forms.append("Creative Commons Legal Code\n\n" + text)
        for form in list(forms):
            if end := END.search(form):
                forms += [form[: end.end()], form[: end.start()]]
        out += [(name, form) for form in forms]
    return out


def notices() -> list[tuple[str, str]]:
    ids = [(i, f"License: {x}") for i in CALLED for x in ((i, f"{i}-only", f"{i}-or-later", f"{i}+") if "GPL" in i or "GFDL" in i else (i,))]
    called = [(i, f"Licensed under {name}{end}") for i, names in CALLED.items() for name in names for end in ("", " License")[: 1 if re.search("(?i)licen[sc]e", name) else 2]]
    return [*NOTICES, *HEADERS, *ids, *called]


def canonical(text: Column) -> Column:
    """The canonical form: ASCII letters and digits of the text in lower case, single spaces, no copyright lines."""
    return _canonical(_without_copyright(text))


def _canonical(bare: Column) -> Column:
    return _spelled(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def _without_copyright(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), COPYRIGHT, " ")


def _spelled(plain: Column) -> Column:
    plain = F.concat(F.lit(" "), plain, F.lit(" "))
    for old, new in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(plain, " +", " "))


def passages(text: Column) -> Column:
    """The canonical forms of the lines and of the paragraphs of a text, without empty ones."""
    return _passages(_without_copyright(text))


def _passages(bare: Column) -> Column:
    rows = F.regexp_replace(bare, "[^a-z0-9\\n]+", " ")
    lines = F.split(_spelled(F.replace(rows, F.lit("\n"), F.lit(" \n "))), " ?\n ?")
    # a paragraph of one line is among the lines
    joined = _spelled(F.replace(F.regexp_replace(F.concat(F.lit("\n\n"), rows, F.lit("\n\n")), " ?\n(?: ?\n)+ ?", " \r "), F.lit("\n"), F.lit(" ")))
    return F.filter(F.concat(lines, F.split(joined, " ?\r ?")), lambda x: x != "")


def _notice(passage: Column) -> Column:
    """A notice with one beginning for all that mean the same."""
    return F.regexp_replace(passage, UNDER, "under ")


def known(spark: SparkSession) -> DataFrame:
    """``license, digest, kind``: the canonical digests of the texts and notices above."""
    rows = [(name, text, "text") for name, text in [*TEXTS, *long_texts()]] + [(name, text, "notice") for name, text in notices()]
    table = spark.createDataFrame(rows, "license string, text string, kind string")
    form = canonical(F.col("text"))
    return table.select("license", F.sha2(F.when(F.col("kind") == "notice", _notice(form)).otherwise(form), 256).alias("digest"), "kind").distinct()


def scanned(df: DataFrame, licenses: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``df`` with ``canonical_sha256``, ``license`` (of the whole text, else NULL) and ``notices`` (sorted names of the
    licences that a whole line or paragraph of the text names)."""
    spark = df.sparkSession
    licenses = cut_lineage(known(spark)) if licenses is None else licenses
    if licenses.limit(KNOWN_BOUND + 1).count() > KNOWN_BOUND:
        raise ValueError(f"more than {KNOWN_BOUND} known licences: join them without a broadcast")
    whole = licenses.groupBy("digest").agg(F.min("license").alias("license"))
    # notices by the first two digits of their digests: a look-up passes over a few entries only
    place = lambda d: F.conv(F.substring(d, 1, 2), 16, 10).cast("int")
    one = licenses.where("kind = 'notice'").groupBy("digest").agg(F.min("license").alias("license")).groupBy(place(F.col("digest")).alias("place"))
    maps = spark.range(256).join(one.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("m")), F.col("id") == F.col("place"), "left")
    keyed = maps.groupBy().pivot("id", list(range(256))).agg(F.first("m"))  # one row
    table = keyed.select(F.array(*[F.coalesce(F.col(f"`{i}`"), F.create_map().cast("map<string,string>")) for i in range(256)]).alias("m"))
    bare, digest, names, of, found = fresh(df, "bare_text", "canonical_digest", "notice_map", "license_of", "license_found")
    # the search for copyright lines is the dearest step, so both forms start from one column
    marked = df.withColumn(bare, _without_copyright(F.col(f"`{text}`"))).withColumn(digest, F.sha2(_canonical(F.col(bare)), 256))
    marked = marked.join(F.broadcast(whole.select(F.col("digest").alias(of), F.col("license").alias(found))), F.col(digest) == F.col(of), "left")
    marked = marked.withColumn(names, table.scalar())
    look = lambda x: let(F.sha2(x, 256), lambda d: F.element_at(F.element_at(F.col(names), place(d) + 1), d))
    hits = F.transform(_passages(F.col(bare)), lambda x: let(_notice(x), lambda n: F.coalesce(look(n), F.when(n != x, look(x)))))
    out = replace(marked, canonical_sha256=F.col(digest), license=F.col(found), notices=F.array_sort(F.array_distinct(F.array_compact(hits))))
    return out.drop(bare, digest, names, of, found)
