"""Licence scans by sentence rules.

Sentences are normalised (lower case, words of letters, digits and inner dots, nothing else) and
mapped to identifiers of known licence sentences; a sentence broken over lines is put together
again. The sequence of identifiers is then matched against ordered rules: at each place the
rule with the longest sequence applies, among equals the earlier one, and what it covers is
used up.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discweave.llm.common import text_or_empty

# Sentences of public licence texts and notices.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is-software": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "no-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "x11-names": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "json-good": "The Software shall be used for Good, not Evil.",
    "ncsa-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-old-grant": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "hpnd-grant": "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib-notice": "This notice may not be removed or altered from any source distribution.",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl11-notice": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl1-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    "cddl-notice": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").',
    "cddl-use": "You may not use this file except in compliance with the License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-deed": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "wtfpl-copy": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "ofl-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "fsfap-copy": "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved.",
    "fsfap-as-is": "This file is offered as-is, without any warranty.",
    "gfdl13-grant": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    "lppl-notice": "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License, either version 1.3 of this license or (at your option) any later version.",
    "mspl-governs": "This license governs use of the accompanying software.",
    "mspl-accept": "If you use the software, you accept this license.",
    "mspl-refuse": "If you do not accept the license, do not use the software.",
    "beer": "As long as you retain this notice you can do whatever you want with this stuff.",
}

# Ordered rules, licence and the sentences in order.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is-software", "no-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-software"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("X11", ["mit-grant", "mit-notice", "as-is-software", "no-liability", "x11-names"]),
    ("JSON", ["mit-grant", "mit-notice", "json-good", "as-is-software", "no-liability"]),
    ("JSON", ["mit-grant", "mit-notice", "json-good"]),
    ("MIT-0", ["mit-0-grant", "as-is-software", "no-liability"]),
    ("MIT-0", ["mit-0-grant"]),
    ("NCSA", ["ncsa-grant"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-old-grant", "isc-as-is"]),
    ("ISC", ["isc-old-grant"]),
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("0BSD", ["0bsd-grant"]),
    ("HPND", ["hpnd-grant"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names", "bsd-as-is"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-title", "boost-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-title"]),
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-grant", "apache-copy"]),
    ("Apache-2.0", ["apache-grant"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope", "agpl-details"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("MPL-1.1", ["mpl11-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("EPL-1.0", ["epl1-notice"]),
    ("CDDL-1.0", ["cddl-notice", "cddl-use"]),
    ("CDDL-1.0", ["cddl-notice"]),
    ("Unlicense", ["unlicense", "unlicense-free"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0"]),
    ("CC0-1.0", ["cc0-deed"]),
    ("WTFPL", ["wtfpl-copy"]),
    ("OFL-1.1", ["ofl-notice"]),
    ("FSFAP", ["fsfap-copy", "fsfap-as-is"]),
    ("FSFAP", ["fsfap-copy"]),
    ("GFDL-1.3-or-later", ["gfdl13-grant"]),
    ("LPPL-1.3c", ["lppl-notice"]),
    ("MS-PL", ["mspl-governs", "mspl-accept", "mspl-refuse"]),
    ("Beerware", ["beer"]),
]

# Licences by the names that one-sentence notices use.
NAMES = {
    "MIT": ["the MIT License", "MIT License", "the MIT licence", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3", "the GNU GPL, version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2", "the GNU GPL, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "BSD-3-Clause"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "BSD-2-Clause"],
    "ISC": ["the ISC License", "ISC"],
    "0BSD": ["the Zero-Clause BSD License", "0BSD"],
    "Zlib": ["the zlib License", "Zlib"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0", "BSL-1.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0", "EPL-2.0"],
    "Unlicense": ["the Unlicense", "Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0", "CC0 1.0 Universal"],
    "WTFPL": ["the WTFPL", "WTFPL"],
    "OFL-1.1": ["the SIL Open Font License, Version 1.1", "OFL-1.1"],
    "Artistic-2.0": ["the Artistic License 2.0", "Artistic-2.0"],
    "MS-PL": ["the Microsoft Public License", "MS-PL"],
    "EUPL-1.2": ["the European Union Public Licence 1.2", "EUPL-1.2"],
    "PostgreSQL": ["the PostgreSQL License", "PostgreSQL"],
    "NCSA": ["the University of Illinois/NCSA Open Source License", "NCSA"],
}
OPENINGS = ["Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This work is released under", "Available under", "SPDX-License-Identifier:"]
CREATIVE_COMMONS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]


BREAK = re.compile(r"(?<=[.!?:;])\s+|[\n\r]+")


def words(sentence: str) -> list[str]:
    """Lower-case words; dots, hyphens and plus signs inside them are kept apart from the end."""
    return re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", sentence.lower())


def notices() -> dict[str, tuple[str, str]]:
    """One-sentence notices, made by rule: identifier to (licence, sentence)."""
    names = {k: list(v) for k, v in NAMES.items()}
    for kind in CREATIVE_COMMONS:
        for version in ("3.0", "4.0"):
            spelled = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
            full = "-".join(spelled[p] for p in kind.split("-"))
            names[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", f"CC-{kind}-{version}", f"a Creative Commons {full} {version} International License", f"the Creative Commons {full} {version} International License"]
    return {f"notice-{licence}-{i}-{j}": (licence, f"{opening} {name}") for licence, spellings in names.items() for i, opening in enumerate(OPENINGS) for j, name in enumerate(spellings)}


class Scanner:
    def __init__(self):
        self.trie: dict = {}
        licences = notices()
        for key, sentence in [*SENTENCES.items(), *((k, s) for k, (_, s) in licences.items())]:
            node = self.trie
            for w in words(sentence):
                node = node.setdefault(w, {})
            node.setdefault("", key)
        self.rules: dict[tuple[str, ...], str] = {}
        for licence, sequence in RULES:
            self.rules.setdefault(tuple(sequence), licence)
        for key, (licence, _) in licences.items():
            self.rules.setdefault((key,), licence)
        self.longest = max(map(len, self.rules))

    def sentences(self, text: str) -> list[str]:
        """Identifiers of the known sentences in order, None for a stretch of others."""
        pieces = [w for p in BREAK.split(text) if (w := words(p))]
        found: list = []
        k = 0
        while k < len(pieces):
            at, node, best, end = k, self.trie, None, k
            while at < len(pieces) and node is not None:
                for w in pieces[at]:
                    node = node.get(w)
                    if node is None:
                        break
                at += 1
                if node is not None and "" in node:
                    best, end = node[""], at
            if best is not None:
                found.append(best)
                k = end
            else:
                if not found or found[-1] is not None:
                    found.append(None)
                k += 1
        return found

    def scan(self, text: str) -> tuple[list[str], list[str]]:
        """(licences in order, known sentences in order)."""
        found, out, k = self.sentences(text), [], 0
        while k < len(found):
            for n in range(min(self.longest, len(found) - k), 0, -1):
                licence = self.rules.get(tuple(found[k : k + n]))
                if licence:
                    out.append(licence)
                    k += n
                    break
            else:
                k += 1
        return out, [s for s in found if s]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licences (in order, parted by ';'), n_licences, sentences (identifiers) of every text.

    A null or empty text and one without known sentences has the empty string and 0. Whole
    texts are scanned, however long and however their sentences are broken. Ids are only carried
    along: null and repeated ones give a row a row. Other columns are not read, so their names
    cannot clash; an empty table gives no rows. No shuffle.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        scan = scanner().scan
        for batch in batches:
            made = [scan(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([";".join(m[0]) for m in made], pa.string()), pa.array([len(m[0]) for m in made], pa.int32()), pa.array([";".join(m[1]) for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "licences", "n_licences", "sentences"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, licences string, n_licences int, sentences string")
