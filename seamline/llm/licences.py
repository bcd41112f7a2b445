"""License scans: canonical digests of whole texts, looked up among the digests of known licences.

Canonical form: copyright lines go, ASCII letters turn small, equivalent spellings become one, and every run of other
characters than ASCII letters and digits becomes one blank. Two texts that differ only in these respects, line breaks
among them, have one SHA-256. A copyright line opens, after comment marks, with the word or the sign and goes on with a year, a
second sign or a year's place holder; at the top of a text a short one may name its holder alone. A wrapped line that just happens
to open with the word stays. The organisation that a BSD licence names in its last clause counts as its owner. Lines that say no
more than that all rights are reserved go with them. Known licences are a fixed list held here (short texts below, long
ones in ``licence_texts``), so their digest table has a size bound (a few hundred rows, it does not grow with the input)
and is broadcast; the documents are neither shuffled nor compared with each other. Only Spark SQL functions run.

The longer licences hold copyright lines inside their paragraphs, and which words share a line with one depends on where
lines break; so these are listed at several widths, with and without the appendix that tells how to apply them.

Next to the whole text, each line is looked up among the known one-line notices, which is how such lines are found
inside longer documents.

Defined cases: a null or empty text has the digest of the empty string and no licence; each row is judged alone, so
repeated rows keep a row each; columns that clash with added names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import textwrap
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equivalent spellings, whole words of the canonical form.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
)

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
"""
_MIT_NOTICE = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.
"""



def _bsd(heads: tuple[str, ...], name: str) -> tuple[str, ...]:
    """Clauses with numbers or bullets, disclaimed by copyright holders or by the author."""
    out = []
    for head, bullets, author in itertools.product(heads, (False, True), (False, True)):
        clauses, warranty = _BSD_GRANT + name, _BSD_WARRANTY
        if bullets:
            clauses = re.sub(r"(?m)^[0-9]\. ", "* ", clauses)
        if author:
            warranty = re.sub("COPYRIGHT HOLDERS?", "AUTHOR", warranty)
        out.append(head + clauses + warranty)
    return tuple(out)


# Whole licence texts.
TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (_MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY, "MIT License\n" + _MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY, "The MIT License (MIT)\n" + _MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY),
    "MIT-0": (_MIT_GRANT.replace(", subject to the following conditions:", ".") + _MIT_WARRANTY, "MIT No Attribution\n" + _MIT_GRANT.replace(", subject to the following conditions:", ".") + _MIT_WARRANTY),
    "BSD-2-Clause": _bsd(("", "BSD 2-Clause License\n", "Simplified BSD License\n"), ""),
    "BSD-3-Clause": _bsd(("", "BSD 3-Clause License\n", "New BSD License\n"), _BSD_NAME),
    "ISC": tuple(
        head
        + """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
        for head in ("", "ISC License\n")
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
""",
    ),
    "WTFPL": (
        """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004
Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed
as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.
""",
    ),
    "0BSD": tuple(
        head
        + """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
        for head in ("", "BSD Zero Clause License\n", "Zero-Clause BSD\n")
    ),
    "BSL-1.0": (
        """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT
HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    ),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>
""",
    ),
    "Apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.
""",
    ),
}

# One-line notices.
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_YEAR = "((19|20)[0-9][0-9]|yyyy|year)"
#: A line that opens, after comment marks, with a copyright word or sign, followed by a sign, a year or its place holder.
COPYRIGHT_LINE = (
    r"(^|\n)[^a-z0-9\n©]*(copyright[^a-z0-9\n©]*(\(c\)|©|" + _YEAR + r")|(\(c\)|©)[^a-z0-9\n]*(copyright[^a-z0-9\n]*)?" + _YEAR + r")[^\n]*"
)
RIGHTS_LINE = r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(\n|$)"
#: Lines at the top of a text where a copyright line may name its holder alone, and the length of such a line at most; further down it
#: has to carry a year or a second sign.
HEAD, SHORT = 8, 120
#: A line that opens, after comment marks, with the word or sign and somebody's capital, "(c)" with a year behind, or names portions.
HOLDER_LINE = (
    r"^[^A-Za-z0-9©]*((([Cc]opyright|COPYRIGHT)[^A-Za-z0-9]+(by )?|©[^A-Za-z0-9]*)[A-Z]|\([Cc]\)[^A-Za-z0-9]*[A-Z].*(19|20)[0-9][0-9]"
    r"|([Pp]ortions|PORTIONS) ([Cc]opyright|COPYRIGHT|\([Cc]\)|©))"
)
#: Words that licences themselves say next to "copyright" are no names.
NO_HOLDER = (
    r"^[^a-z0-9©]*(copyright|©)[^a-z0-9]+(the )?(copyright|holders?|owners?|notices?|laws?|licen[cs]e|and|in|or|is|interests?|statements?|treat(y|ies)|act|protection|status|disclaimer|permission|office|free)"
    r"([^a-z]|$)"
)
#: The organisation that a BSD licence names in its last clause.
NAMED = "neither the names? of [a-z0-9 ]{1,120}? nor the names? of (its|the|their|his|any) contributors"
NAMELESS = "neither the name of the copyright owner nor the names of its contributors"
#: Line widths at which texts with copyright lines inside are listed; None: a paragraph a line.
WIDTHS = (60, 66, 70, 72, 74, 76, 78, 79, 80, 100, 120, None)
END = "END OF TERMS AND CONDITIONS"


def _names_holder(line: Column) -> Column:
    return (F.length(line) <= SHORT) & F.rlike(line, F.lit(HOLDER_LINE)) & ~F.rlike(F.translate(line, UPPER, LOWER), F.lit(NO_HOLDER))


def names_holder(line: str) -> bool:
    return len(line) <= SHORT and bool(re.search(HOLDER_LINE, line)) and not re.search(NO_HOLDER, line.translate(str.maketrans(UPPER, LOWER)))


def canonical(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    lines = F.split(t, "\n", -1)
    head = F.filter(F.slice(lines, F.lit(1), F.lit(HEAD)), lambda x: ~_names_holder(x))
    t = F.concat_ws("\n", F.array_join(head, "\n"), F.substring(t, F.length(F.array_join(F.slice(lines, F.lit(1), F.lit(HEAD)), "\n")) + 1, F.length(t)))
    t = F.translate(t, UPPER, LOWER)
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT_LINE, "\n"), RIGHTS_LINE, "\n")
    t = F.concat(F.lit(" "), F.regexp_replace(t, "[^a-z0-9]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(t, NAMED, NAMELESS))


def canonical_text(text: str) -> str:
    """The same form of a Python string, for the known texts."""
    lines = text.split("\n")
    t = "\n".join([x for x in lines[:HEAD] if not names_holder(x)] + lines[HEAD:]).translate(str.maketrans(UPPER, LOWER))
    t = re.sub(RIGHTS_LINE, "\n", re.sub(COPYRIGHT_LINE, "\n", t))
    t = " " + re.sub("[^a-z0-9]+", " ", t) + " "
    for old, new in SPELLINGS:
        t = t.replace(f" {old} ", f" {new} ")
    return re.sub(NAMED, NAMELESS, t).strip(" ")


def reflow(text: str, width: int | None) -> str:
    """The same paragraphs with lines of ``width`` characters at most."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n[ \t\f]*\n", text)]
    fill = lambda p: textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) if width else p
    return "\n\n".join(map(fill, filter(None, paragraphs)))


def _listed(text: str):
    yield text
    if re.search(r"copyright[^a-z0-9]*(\(c\)|©|" + _YEAR + ")", text.lower()):
        yield from (reflow(text, w) for w in WIDTHS)


@functools.cache
def known_texts() -> dict[str, tuple[str, ...]]:
    """Whole texts of each known licence: those above, and the files of ``licence_texts``, whose names are the licences'."""
    known = {k: list(v) for k, v in TEXTS.items()}
    for path in sorted(Path(__file__).with_name("licence_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        terms, end, _ = text.partition(END)
        known.setdefault(path.stem, []).extend(dict.fromkeys((text, terms + end, terms)))
    return {k: tuple(v) for k, v in known.items()}


@functools.cache
def known_digests() -> list[tuple[str, str]]:
    """(digest, licence) of the fixed list: a few hundred rows at any input size."""
    texts = [(name, w) for name, own in known_texts().items() for t in own for w in _listed(t)]
    texts += [(name, t) for name, own in NOTICES.items() for t in own]
    return sorted({(hashlib.sha256(canonical_text(t).encode()).hexdigest(), name) for name, t in texts})


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add canonical_sha256, license_id (of the whole text, else null) and notice_ids (licences of known notice lines)."""
    spark = docs.sparkSession
    base = docs.drop("canonical_sha256", "license_id", "notice_ids")
    known = spark.createDataFrame(known_digests(), "canonical_sha256 string, license_id string")
    notices = {canonical_text(t): name for name, texts in NOTICES.items() for t in texts}
    by_line = F.create_map(*[F.lit(x) for kv in sorted(notices.items()) for x in kv])
    # Only lines as long as a notice can be one once blanks are squeezed; the word test spares the others the regexes.
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.contains(F.translate(x, UPPER, LOWER), F.lit("licen")))
    named = F.transform(lines, lambda x: F.element_at(by_line, canonical(x)))
    out = base.withColumn("canonical_sha256", F.sha2(canonical(F.col(text)), 256))
    out = out.withColumn("notice_ids", F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))))
    return out.join(F.broadcast(known), "canonical_sha256", "left").select(*base.columns, "canonical_sha256", "license_id", "notice_ids")
