"""Licence scan: a trained paragraph classifier, confirmed by templates.

The classifier is a sparse multinomial logistic regression over the word 1- and 2-grams a
paragraph holds.  It is trained on the driver, in a few seconds, from public notices and
names of licences set into phrases, altered at random, against prose, texts that speak of
rights, products of a family's name, and other licences; those make up the class ``unknown``.
Families are looked for where the odds against ``unknown`` reach a bound that one in twenty held-out
paragraphs without a family reaches.  The reported number is the model's odds of a family against all
else, ``unknown`` included, made a probability by a logistic curve (Platt) fitted on held-out wordings:
phrases, names, notices, products and other licences that the training never sees, two of them in a
paragraph now and then.

A predicted family is confirmed if the paragraph holds enough of the grams of one of the
family's templates, at least one of the grams that decide its version or number of clauses,
and none that speak for a sibling.  Where the template is but a name, nothing may deny it (``not under``,
``license server``); where the name alone may be anything else (``isc``, ``apache 2``), the
paragraph must also speak of licensing, or say nothing but names.  A paragraph may name several families.
Held-out names are no templates.

Scoring is built-in expressions over literals: weights are whole numbers, so sums are
exact.  A paragraph is scored only if it holds one of the model's anchor words.  They are
chosen so that without any of them no family can outweigh ``unknown``, whatever else the
paragraph holds, so this changes no result.
"""

from __future__ import annotations

import functools
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import fresh, normal_words

UNKNOWN = "unknown"
SCALE = 1 << 16
#: Share of the grams of a notice or line, and of a name, that a paragraph must hold.
CONFIRM, NAMED = 0.6, 0.5
#: A family of a smaller probability is not considered; so many paragraphs without a family may pass as having one, before confirmation.
LEAST, PASSING = 0.02, 0.05

# Notices by which works are put under well-known licences.
TEMPLATES = {
    "agpl-3.0": [
        "GNU Affero General Public License Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache-2.0": [
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd-3-clause": [
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "bsd-2-clause": [
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS",
        "Licensed under the Simplified BSD License.",
    ],
    "cc-by-4.0": [
        "Creative Commons Attribution 4.0 International",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 license.",
    ],
    "cc-by-nc-4.0": [
        "Creative Commons Attribution-NonCommercial 4.0 International",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-nc-nd-4.0": [
        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "cc-by-nc-sa-4.0": [
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "cc-by-nd-4.0": [
        "Creative Commons Attribution-NoDerivatives 4.0 International",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
    ],
    "cc-by-sa-4.0": [
        "Creative Commons Attribution-ShareAlike 4.0 International",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc0-1.0": [
        "CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
        "Released under CC0 1.0 public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl-2.0": [
        "GNU General Public License Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "gpl-3.0": [
        "GNU General Public License Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl-2.1": [
        "GNU Lesser General Public License Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "lgpl-3.0": [
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "mit": [
        "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "Released under the MIT License.",
        "This project is licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "unlicense": [
        "The Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
}

# Names of the families; the second list is kept out of the training.
NAMES = {
    "agpl-3.0": (["GNU AGPL v3", "AGPLv3", "AGPL-3.0-only", "Affero General Public License v3.0", "AGPL version 3"], ["GNU Affero GPL version 3", "AGPL 3.0 licence"]),
    "apache-2.0": (["Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache 2.0", "Apache License v2.0", "Apache 2", "Apache licence 2.0", "Apache license, version 2"], ["Apache Software License, version 2.0", "Apache-2.0 licence", "Apache v2 license"]),
    "bsd-2-clause": (["BSD-2-Clause", "2-clause BSD license", "BSD 2-Clause licence", "Simplified BSD License", "two-clause BSD license"], ["BSD 2-clause \"Simplified\" license", "FreeBSD License", "2-clause BSD licence"]),
    "bsd-3-clause": (["BSD-3-Clause", "3-clause BSD license", "BSD 3-Clause licence", "New BSD License", "three-clause BSD license", "Modified BSD License"], ["BSD 3-clause \"New\" or \"Revised\" license", "Revised BSD License", "3-clause BSD licence"]),
    "cc-by-4.0": (["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0", "Creative Commons BY 4.0"], ["Creative Commons Attribution 4.0 licence", "CC-BY 4.0 International"]),
    "cc-by-nc-4.0": (["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons BY-NC 4.0", "Creative Commons Attribution Non-Commercial 4.0"], ["CC BY NC 4.0 licence", "CC-BY-NC 4.0 International"]),
    "cc-by-nc-nd-4.0": (["CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "Creative Commons BY-NC-ND 4.0"], ["CC BY NC ND 4.0 licence", "CC-BY-NC-ND 4.0 International"]),
    "cc-by-nc-sa-4.0": (["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons BY-NC-SA 4.0"], ["CC BY NC SA 4.0 licence", "CC-BY-NC-SA 4.0 International"]),
    "cc-by-nd-4.0": (["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0"], ["CC BY ND 4.0 licence", "CC-BY-ND 4.0 International"]),
    "cc-by-sa-4.0": (["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons BY-SA 4.0", "Creative Commons Attribution Share-Alike 4.0"], ["CC BY SA 4.0 licence", "CC-BY-SA 4.0 International"]),
    "cc0-1.0": (["CC0", "CC0 1.0", "CC0-1.0", "Creative Commons Zero 1.0", "CC0 public domain dedication", "Creative Commons Zero"], ["CC0 waiver", "Creative Commons CC0 licence"]),
    "gpl-2.0": (["GPLv2", "GNU GPL v2", "GPL-2.0", "GPL version 2", "GNU General Public License v2", "GPL-2.0-or-later", "GNU General Public Licence, version 2", "GNU GPL version 2 or later", "GPL 2"], ["GNU GPL 2.0", "GPL v2 licence", "General Public License v2.0"]),
    "gpl-3.0": (["GPLv3", "GNU GPL v3", "GPL-3.0", "GPL version 3", "GNU General Public License v3", "GPL-3.0-only", "GNU General Public Licence, version 3", "GNU GPL version 3 or later", "GPL 3"], ["GNU GPL 3.0", "GPL v3 licence", "General Public License v3.0"]),
    "isc": (["ISC", "ISC license", "ISC licence", "Internet Systems Consortium license"], ["ISC-style license", "Internet Systems Consortium (ISC) licence"]),
    "lgpl-2.1": (["LGPLv2.1", "GNU LGPL v2.1", "LGPL-2.1", "LGPL version 2.1", "GNU Lesser General Public License v2.1", "LGPL-2.1-or-later", "GNU LGPL 2.1"], ["LGPL v2.1 licence", "Lesser GPL version 2.1"]),
    "lgpl-3.0": (["LGPLv3", "GNU LGPL v3", "LGPL-3.0", "LGPL version 3", "GNU Lesser General Public License v3", "LGPL-3.0-only", "GNU LGPL 3", "LGPL 3"], ["LGPL v3 licence", "Lesser GPL version 3"]),
    "mit": (["MIT License", "MIT licence", "MIT/X11 license", "Expat license", "MIT or Apache", "X11 license", "or MIT"], ["MIT (Expat) license", "MIT-style permissive license", "or MIT licence"]),
    "mpl-2.0": (["MPL 2.0", "MPL-2.0", "MPLv2", "Mozilla Public License 2.0", "Mozilla Public Licence, version 2.0", "MPL v2.0", "Mozilla Public License v2"], ["MPL 2.0 licence", "MPL version 2"]),
    "unlicense": (["Unlicense", "The Unlicense", "Unlicense license"], ["Unlicense (public domain)"]),
}

# Phrases that put a work under a licence; the second list is kept out of the training.
PHRASES = (
    ["{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This project is licensed under the {}.", "License: {}",
     "SPDX-License-Identifier: {}", "This work is licensed under the {}.", "under the terms of the {}", "This file is part of a library under {}; see COPYING."],
    ["Distributed under the {}.", "The code is available under the {}.", "Published under {}.", "You may use it under the {}.", "Copyright 2020 the authors, {}."],
)

# Licences that belong to none of the families; the second list is kept out of the training.
OTHERS = (
    ["Eclipse Public License 2.0", "zlib License", "Boost Software License 1.0", "SIL Open Font License 1.1", "Python Software Foundation License",
     "Academic Free License 3.0", "CDDL 1.0", "Microsoft Public License", "GNU Free Documentation License 1.3", "Open Database License 1.0", "NASA Open Source Agreement 1.3"],
    ["Artistic License 2.0", "PostgreSQL License", "EUPL 1.2", "WTFPL", "Sleepycat License", "Common Public License 1.0", "Ruby License", "OpenSSL License"],
)

_GNU = ("affero", "agpl", "agplv3", "lesser", "lgpl", "lgplv3", "lgplv2", "library general")


def _versions(number: str, *names: str) -> tuple[str, ...]:
    """Grams that state a version: after a word such as ``version``, or joined to a name."""
    after = ("version", "license", "licence", "v", *names)
    return tuple(f"{w} {number}" for w in after) + (f"v{number}",) + tuple(f"{n}v{number}" for n in names)


_NC = ("nc", "noncommercial", "non commercial")
_SA = ("sa", "sharealike", "share alike")
_ND = ("nd", "noderivatives", "no derivatives")
#: Of each of the first groups of grams a paragraph must hold one, of the last group none,
#: for the family to be confirmed.
DECIDING: dict[str, tuple[tuple[tuple[str, ...], ...], tuple[str, ...]]] = {
    "agpl-3.0": ((_versions("3", "agpl", "gpl"), ("affero", "agpl", "agplv3")), ()),
    "apache-2.0": ((_versions("2", "apache"), ("apache",)), ()),
    "bsd-2-clause": ((("2 clause", "two clause", "simplified bsd", "bsd 2", "reproduce the"),), ("3 clause", "three clause", "neither the", "endorse or")),
    "bsd-3-clause": ((("3 clause", "three clause", "new bsd", "modified bsd", "revised bsd", "neither the", "endorse or"),), ("2 clause", "two clause")),
    "cc-by-4.0": ((("4 0",),), (*_NC, *_SA, *_ND)),
    "cc-by-nc-4.0": ((("4 0",), _NC), (*_SA, *_ND)),
    "cc-by-nc-nd-4.0": ((("4 0",), _NC, _ND), _SA),
    "cc-by-nc-sa-4.0": ((("4 0",), _NC, _SA), _ND),
    "cc-by-nd-4.0": ((("4 0",), _ND), (*_NC, *_SA)),
    "cc-by-sa-4.0": ((("4 0",), _SA), (*_NC, *_ND)),
    "cc0-1.0": ((("cc0", "commons zero"),), ()),
    "gpl-2.0": ((_versions("2", "gpl"),), _GNU),
    "gpl-3.0": ((_versions("3", "gpl"),), _GNU),
    "isc": ((("isc", "internet systems", "and or"),), ()),
    "lgpl-2.1": ((("2 1", "v2 1", "lgplv2 1"), ("lesser", "lgpl", "lgplv2")), ()),
    "lgpl-3.0": ((_versions("3", "lgpl", "gpl"), ("lesser", "lgpl", "lgplv3")), ()),
    "mit": ((("mit license", "mit licence", "mit x11", "x11 license", "expat license", "or mit", "mit or", "identifier mit", "free of"),), ()),
    "mpl-2.0": ((_versions("2", "mpl"), ("mozilla", "mpl", "mplv2")), ()),
    "unlicense": ((("unlicense", "and unencumbered"),), ()),
}

# Texts that hold a family's name and put nothing under it; the second list is kept out of the training.
PRODUCTS = (
    ["Apache 2.4.6 is a web server.", "Install Apache 2 with the package manager.", "The ISC meeting was held in Paris.", "ISC DHCP 4 assigns addresses.", "X11 window server", "The license server is down.",
     "CC0 was the code of the old bus line.", "The MIT campus is near the river.", "Mozilla 2.0 shipped with a new engine.", "The GNU debugger version 3 was announced.", "BSD 3 was a release of the operating system.",
     "Creative Commons held a summit.", "He left Harvard or MIT in spring.", "Version 2 of the public register is available.", "This is not licensed under the GPL version 2.", "Unlike the MIT license, ours has a clause on patents."],
    ["Apache 2.2 reached its end of life.", "ISC published a report on name servers.", "Restart Apache 2 after the change.", "The X11 session did not start.", "A talk at MIT on robots.", "FreeBSD 3 and 2 were compared.", "Track CC0 is closed.", "The GNU tools, version 2, run on it."],
)
# Grams that deny a name, and grams by which a paragraph speaks of licensing.
DENIED = (
    "not under", "not licensed", "not released", "not covered", "not available", "not distributed", "not use", "no longer", "never under", "isn t", "aren t", "instead of", "rather than", "unlike the", "other than",
    "license server", "license manager", "license key", "license fee", "license plate", "licence fee", "incompatible with",
)
CONTEXT = (
    "license", "licence", "licensed", "licenced", "licensing", "relicensed", "licenses", "licences", "spdx", "terms", "released under", "distributed under", "available under", "provided under", "under apache", "under cc0", "under creative", "under isc", "under mit", "covered", "subject", "applies", "copying", "governed", "dedication", "waiver",
    "waived", "permissive",
)
#: Families whose bare name may mean something else.
AMBIGUOUS = ("apache-2.0", "cc0-1.0", "isc", "mit")
#: A template of so many grams or more is a notice, not a name.
NOTICE = 8

# Texts about rights that name no family.
RIGHTS = [
    "All rights reserved.", "Copyright 2021 by the author. All rights reserved.", "See the LICENSE file for details.",
    "Licensed under the terms of the attached license agreement.", "This work is licensed to the publisher only.",
    "Released under a proprietary license; redistribution is not permitted.", "He lost his driving license last year.",
    "The software license fee is due every year.", "Licensed premises: no alcohol may be sold to persons under the age of 18.",
    "This file is confidential and proprietary. Use without written permission is prohibited.",
    "The album was released under the title of an older work.", "Terms of use: you may not copy or distribute this content.",
    "A new version of the program was released in May.", "Patents pending. Trademarks belong to their owners.",
    "The foundation published the general terms in version 3 of its report.", "Students at MIT presented their project.",
    "The public library is free and open to anyone.", "Apache helicopters were seen over the site.",
    "The Mozilla browser, version 2.0, was published by the foundation.", "The creative commons of the village is a public place.",
    "Use of the source code is subject to the following conditions.", "This license may not be transferred to any other person.",
]

# Plain prose.
PROSE = [
    "The weather in the north was cold, and the river froze over for most of the winter.",
    "She walked to the market with her brother and bought bread, apples and a little cheese.",
    "In the following chapter we describe the method and the results of the experiment.",
    "He said that the work was done and that anyone could see it for free.",
    "This is the first time that the team has won the cup in more than ten years.",
    "You can find the house at the end of the road, with a red door and a small garden.",
    "It was either a mistake or a joke, but nobody in the room was willing to say so.",
    "The new train runs faster and uses less power than the old one.",
    "Please put the copy of the form in the box by the door and keep the other for yourself.",
    "With or without help, they would have to reach the top of the hill before night.",
    "All of the above is provided by the people who live in this part of the country.",
    "The author of the book thanked her publisher and the public for their support.",
    "Any person who wants to use the hall must ask for permission from the office.",
    "A list of conditions was put on the wall, but it was too small to be read.",
    "The keys were under the mat by the shelf, and every file and document is subject to a check.",
    "The new library of the town is released from debt and has been published in the paper.",
    "What can be done to make it work, is it available, and at what price does the shop sell it?",
    "We merge onto the main road, deal with the traffic, and then obtain a code at the gate.",
]

#: Everyday words, of other languages too; alone they say nothing about a licence.
EVERYDAY = (
    "mit", "a", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "for", "from", "has", "have", "in", "is", "it", "its", "may", "must",
    "no", "not", "of", "on", "one", "only", "or", "other", "our", "shall", "such", "that", "the", "their", "these", "they", "this", "those", "to", "two", "three",
    "under", "was", "we", "were", "who", "whom", "will", "with", "without", "you", "your", "later", "following", "including", "project", "program",
    "sa", "nd", "met", "source", "general", "international", "foundation", "option", "purpose", "notice", "rights", "commercial", "extent", "related", "domain",
    "zero", "universal", "systems", "charge", "publish", "associated", "limitation", "permitted", "possible", "internet", "fee", "forms", "new", "share",
)

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Model:
    """Whole-number weights: a row of ``weights`` for each gram, a column for each class, ``unknown`` last."""

    families: tuple[str, ...]
    grams: tuple[str, ...]
    weights: tuple[tuple[int, ...], ...]
    bias: tuple[int, ...]
    slope: float
    shift: float
    threshold: float
    anchors: tuple[str, ...]
    notices: tuple[tuple[tuple[str, ...], ...], ...]
    lines: tuple[tuple[tuple[str, ...], ...], ...]
    names: tuple[tuple[tuple[str, ...], ...], ...]
    ambiguous: tuple[tuple[tuple[str, ...], ...], ...]
    name_words: tuple[str, ...]


def words_of(text: str) -> list[str]:
    """Lower-cased words; ``licence`` is spelt ``license``."""
    return WORD.findall(text.lower().replace("licence", "license"))


def _spelt(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("licence"), F.lit("license"))


def grams_of(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _template(text: str) -> tuple[str, ...]:
    """The 2-grams of a notice or name; of a single word, the word."""
    words = words_of(text)
    return tuple(sorted(g for g in grams_of(words) if " " in g)) or tuple(words)


def _examples(seed: int, copies: int, kept: int) -> list[tuple[set[str], int]]:
    """Altered wordings by the number of their family, and others under the number after the last.

    Held-out products stand beside held-out rights and prose.

    ``kept`` 0 gives those to train on, 1 the held-out ones: other phrases and names, and of
    the notices of a family the longest one cut to its halves, which stand in no phrase.
    """
    rng = random.Random(seed)
    families = sorted(TEMPLATES)
    pool = [w for text in PROSE[kept::2] for w in words_of(text)]
    named = [w for texts in TEMPLATES.values() for text in texts for w in words_of(text)[:100] if len(text) > 150]

    def altered(text: str, loss: float) -> list[str]:
        words = [w for w in words_of(text) if rng.random() > loss]
        return rng.choices(pool, k=rng.choice((0, 0, 3, 8))) + words + rng.choices(pool, k=rng.choice((0, 0, 3, 8)))

    def phrase(name: str) -> str:
        return rng.choice(PHRASES[kept]).format(name)

    out = []
    for k, family in enumerate(families):
        for text in TEMPLATES[family]:
            words = text.split()
            if len(words) >= 20:
                for _ in range(copies):
                    half = len(words) * 2 // 3
                    part = " ".join(words[:half] if rng.random() < 0.5 else words[-half:]) if kept else text
                    out.append((grams_of(altered(part, rng.uniform(0, 0.12))), k))
            elif not kept:
                out += [(grams_of(altered(text, 0.0)), k) for _ in range(copies)]
        for name in NAMES[family][kept]:
            out += [(grams_of(altered(phrase(name), 0.0)), k) for _ in range(copies)]
    other = len(families)
    for text in RIGHTS[kept::2] + PROSE[kept::2] + PRODUCTS[kept]:
        out += [(grams_of(altered(text, 0.1)), other) for _ in range(copies)]
    for name in OTHERS[kept]:
        out += [(grams_of(altered(phrase(name), 0.0)), other) for _ in range(2 * copies)]
    for _ in range(40 * copies):  # licences of made-up names
        name = f"{rng.choice(pool)} {rng.choice(('', 'Public ', 'Open Source ', 'Software '))}{rng.choice(('License', 'Licence'))}"
        out.append((grams_of(altered(phrase(name + rng.choice(("", " 1.0", " 1.1", ", version 1"))), 0.0)), other))
    # Words of notices in no order, to learn that order matters; they say nothing about real texts, so none is held out.
    for words, most in ((named, 14), (named + pool, 30)) if not kept else ():
        out += [(grams_of(rng.choices(words, k=rng.randint(3, most))), other) for _ in range(10 * copies)]
    return out


def _matrix(examples: list[tuple[set[str], int]], column: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(examples), len(column)), dtype=np.float32)
    for i, (grams, _) in enumerate(examples):
        x[i, [column[g] for g in grams if g in column]] = 1
    return x, np.array([k for _, k in examples])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, classes: int, l1: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient for the L1-penalised multinomial loss."""
    n, d = x.shape
    target = np.eye(classes, dtype=np.float32)[y]
    w = np.zeros((d, classes), dtype=np.float32)
    b = np.zeros(classes, dtype=np.float32)
    ahead_w, ahead_b, t = w, b, 1.0
    rate = 4.0 * n / float(np.square(x).sum(axis=1).max() * n / 4)
    for _ in range(rounds):
        error = (_softmax(x @ ahead_w + ahead_b) - target) / n
        step = ahead_w - rate * (x.T @ error)
        new_w = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        new_b = ahead_b - rate * error.sum(axis=0)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead_w = new_w + (t - 1) / t_next * (new_w - w)
        ahead_b = new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return w, b


def _anchor_words(grams: list[str], weights: np.ndarray, bias: np.ndarray, plain: set[str]) -> list[str]:
    """Words, none of them plain, without which no family's score can exceed that of ``unknown``."""
    lead = np.maximum(weights[:, :-1] - weights[:, -1:], 0)
    base = bias[:-1] - bias[-1]
    holds: dict[str, list[int]] = {}
    for i, gram in enumerate(grams):
        for word in (w for w in gram.split() if w not in plain and not w.isdigit()):
            holds.setdefault(word, []).append(i)
    left = np.ones(len(grams), dtype=bool)
    anchors = []
    while (open_ := (base + lead[left].sum(axis=0)) > 0).any():
        gain = {w: lead[[i for i in at if left[i]]][:, open_].sum() for w, at in holds.items() if w not in anchors}
        best = max(sorted(gain), key=gain.get)
        anchors.append(best)
        left[holds[best]] = False
    return sorted(anchors)


def _odds(scores: np.ndarray) -> np.ndarray:
    """Log odds of each family against all other classes."""
    top = scores.max(axis=1, keepdims=True)
    e = np.exp(scores - top)
    return (scores - top - np.log(np.maximum(e.sum(axis=1, keepdims=True) - e, 1e-30)))[:, :-1]


def _licensed(scores: np.ndarray) -> np.ndarray:
    """Log odds of all families together against ``unknown``."""
    top = scores.max(axis=1)
    return top + np.log(np.maximum(np.exp(scores[:, :-1] - top[:, None]).sum(axis=1), 1e-30)) - scores[:, -1]


def _platt(odds: np.ndarray, named: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve from odds to how often the family is named, by Newton's method."""
    v, t = np.clip(odds.ravel(), -30, 30), named.ravel().astype(float)
    slope, shift = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(slope * v + shift)))
        g, w = p - t, np.maximum(p * (1 - p), 1e-9)
        a, b, c = (w * v * v).sum() + 1e-6, (w * v).sum(), w.sum() + 1e-6
        ga, gb = (g * v).sum(), g.sum()
        slope, shift = slope - (c * ga - b * gb) / (a * c - b * b), shift - (a * gb - b * ga) / (a * c - b * b)
        slope = min(max(slope, 0.05), 20.0)
    return float(slope), float(shift)


def _held_out(seed: int, copies: int) -> list[tuple[set[str], set[int]]]:
    """Held-out paragraphs with the families they name; now and then two of them in one."""
    rng = random.Random(seed)
    single = _examples(seed, copies, 1)
    other = len(TEMPLATES)
    out = [(grams, {k} - {other}) for grams, k in single]
    for _ in range(len(single) // 8):
        (a, i), (b, j) = rng.choice(single), rng.choice(single)
        out.append((a | b, {i, j} - {other}))
    return out


@functools.cache
def train(seed: int = 7, copies: int = 24) -> Model:
    """The same model whenever it is trained."""
    families = sorted(TEMPLATES)
    fit, kept = _examples(seed, copies, 0), _held_out(seed + 1, copies)
    seen: dict[str, int] = {}
    for grams, _ in fit:
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
    texts = [t for f in families for t in TEMPLATES[f] + [p.format(n) for n in NAMES[f][0] for p in PHRASES[0]]]
    texts += [p.format(n) for n in OTHERS[0] for p in PHRASES[0]] + PRODUCTS[0]
    named = {g for text in texts for g in grams_of(words_of(text))}
    # Grams of plain words and numbers alone say nothing about a licence.
    plain = {w for text in PROSE for w in words_of(text)} | set(EVERYDAY)
    grams = sorted(
        g for g, n in seen.items() if n >= 3 and g in named and not all(w in plain or w.isdigit() for w in g.split())
    )
    column = {g: i for i, g in enumerate(grams)}
    x, y = _matrix(fit, column)
    w, b = _fit(x, y, len(families) + 1, l1=1e-4, rounds=250)
    whole = np.rint(np.concatenate([w, b[None]]) * SCALE).astype(int)
    hx, _ = _matrix([(g, 0) for g, _ in kept], column)
    z = (hx.astype(np.float64) @ whole[:-1] + whole[-1]) / SCALE
    odds, truth = _odds(z), np.array([[k in own for k in range(len(families))] for _, own in kept])
    slope, shift = (round(v, 6) for v in _platt(odds, truth))
    # So few of the held-out paragraphs that name no family may pass for ones that do.
    wrong = np.sort(_licensed(z)[~truth.any(axis=1)])
    threshold = round(float(wrong[int(len(wrong) * (1 - PASSING))]) + 1e-3, 3)
    used = np.flatnonzero(np.abs(whole[:-1]).sum(axis=1))
    grams = [grams[i] for i in used]
    weights, bias = whole[used], whole[-1]
    own = [[(t, _template(t)) for t in TEMPLATES[f] + NAMES[f][0]] for f in families]
    says = re.compile("licen[sc]e", re.IGNORECASE)
    vague = lambda f, text: f in AMBIGUOUS and not says.search(text)
    kinds: list[list[tuple]] = [[], [], [], []]
    for family, rows in zip(families, own, strict=True):
        kind = [0 if len(t) >= NOTICE else 3 if vague(family, text) else 1 if text in TEMPLATES[family] else 2 for text, t in rows]
        for k in range(4):
            kinds[k].append(tuple(dict.fromkeys(t for (_, t), at in zip(rows, kind, strict=True) if at == k)))
    return Model(
        families=tuple(families),
        grams=tuple(grams),
        weights=tuple(tuple(int(v) for v in row) for row in weights),
        bias=tuple(int(v) for v in bias),
        slope=slope,
        shift=shift,
        threshold=threshold,
        anchors=tuple(_anchor_words(grams, weights, bias, plain)),
        notices=tuple(kinds[0]),
        lines=tuple(kinds[1]),
        names=tuple(kinds[2]),
        ambiguous=tuple(kinds[3]),
        name_words=tuple(sorted({w for f in families for n in [*NAMES[f][0], *(t for t in TEMPLATES[f] if len(t) < 30 and vague(f, t))] for w in words_of(n)} | {"and", "or", "the"})),
    )


def _parts(value: str | Column, mark: str) -> Column:
    """``array<string>`` of a joined string, one literal however many parts: plans stay small."""
    return F.split(F.lit(value) if isinstance(value, str) else value, mark)


def classify(words: Column, model: Model) -> Column:
    """``array<struct<family, probability, confirmed>>``: the families predicted for a paragraph's words."""
    grams, classes = _parts(",".join(model.grams), ","), len(model.families) + 1
    weights = _parts(",".join(str(v) for row in model.weights for v in row), ",").cast("array<bigint>")
    bias = _parts(",".join(map(str, model.bias)), ",").cast("array<bigint>")
    families = _parts(",".join(model.families), ",")
    # By family: groups of grams, commas between grams, semicolons between groups.
    joined = lambda groups: ";".join(",".join(g) for g in groups)
    notices, lines, names, ambiguous = (_parts("|".join(joined(t) for t in kind), r"\|") for kind in (model.notices, model.lines, model.names, model.ambiguous))
    context, denied, name_words = (_parts(",".join(v), ",") for v in (CONTEXT, DENIED, model.name_words))
    some = _parts("|".join(joined(DECIDING[f][0]) for f in model.families), r"\|")
    none = _parts("|".join(",".join(DECIDING[f][1]) for f in model.families), r"\|")

    def judge(x: Column) -> Column:
        scores = F.aggregate(
            F.array_intersect(x, grams),
            bias,
            lambda acc, g: F.zip_with(acc, F.slice(weights, (F.array_position(grams, g).cast("int") - 1) * classes + 1, classes), lambda a, b: a + b),
        )

        def against(s: Column) -> Column:
            z = F.transform(s, lambda v: v / F.lit(float(SCALE)))
            e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
            rest = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
            odds = lambda v, k: v - F.array_max(z) - F.log(F.greatest(rest - F.get(e, k), F.lit(1e-30)))
            sure = lambda v, k: F.round(1 / (1 + F.exp(-(odds(v, k) * model.slope + model.shift))), 6)
            ahead = F.transform(F.slice(z, 1, classes - 1), lambda v, k: F.when(v > F.element_at(z, -1), F.struct(k.alias("k"), sure(v, k).alias("p"))))
            licensed = F.array_max(z) + F.log(F.greatest(rest - F.element_at(e, -1), F.lit(1e-30))) - F.element_at(z, -1)
            return F.when(licensed >= model.threshold, F.filter(ahead, lambda r: r.isNotNull() & (r["p"] >= LEAST))).otherwise(F.array().cast("array<struct<k:int,p:double>>"))

        def enough(t: Column, share: float) -> Column:
            own = _parts(t, ",")
            return (t != "") & (F.size(F.array_intersect(x, own)) >= F.size(own) * F.lit(share))

        bare = F.size(F.array_except(F.filter(x, lambda g: ~F.contains(g, F.lit(" "))), name_words)) == 0
        spoken = F.arrays_overlap(x, context) | bare
        free = ~F.arrays_overlap(x, denied)

        def confirm(r: Column) -> Column:
            of = lambda kind, share: F.exists(_parts(F.get(kind, r["k"]), ";"), lambda t: enough(t, share))
            held = of(notices, CONFIRM) | (free & (of(lines, CONFIRM) | of(names, NAMED) | (of(ambiguous, NAMED) & spoken)))
            decided = F.forall(_parts(F.get(some, r["k"]), ";"), lambda group: F.arrays_overlap(x, _parts(group, ",")))
            sibling = F.arrays_overlap(x, _parts(F.get(none, r["k"]), ","))
            return F.struct(F.get(families, r["k"]).alias("family"), r["p"].alias("probability"), (held & decided & ~sibling).alias("confirmed"))

        return F.transform(F.get(F.transform(F.array(scores), against), F.lit(0)), confirm)

    def grams_in(w: Column) -> Column:
        following = F.slice(w, 2, 1 << 30)
        return F.array_distinct(F.concat(w, F.zip_with(F.slice(w, F.lit(1), F.size(following)), following, lambda a, b: F.concat_ws(" ", a, b))))

    # Each step's array is bound to a name, or every use would work it out again.
    return F.get(F.transform(F.transform(F.array(words), grams_in), judge), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Lines, and after them the blocks between blank lines that have several lines."""
    lines = F.split(text, "\n")
    blocks_ = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda b: F.contains(F.trim(b), F.lit("\n")))
    return F.concat(lines, blocks_)


def scan(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """All columns of ``docs`` and what licence notices the text holds.

    ``license``: the confirmed family of the highest probability (of equal ones the first by
    name); ``unknown`` if paragraphs were put in a family but none was confirmed; else null.
    ``license_probability`` goes with it (rounded to 6 places; for ``unknown`` the highest).
    ``license_families``: the confirmed families, sorted and comma-joined.
    ``n_license_paragraphs``: paragraphs put in a family.

    Null, empty and wordless texts hold none; rows map one to one, repeated ones too; no rows
    give no rows; only columns of those names are replaced.  Nothing is shuffled and no
    Python runs on the executors.
    """
    model = model or train()
    word = r"[\p{L}\p{M}\p{N}]"
    letters = "".join(sorted({a[0] for a in model.anchors}))
    gate = f"(?=[{letters}])(?<!{word})(?:{'|'.join(model.anchors)})(?!{word})"
    text = F.coalesce(F.col(text_col), F.lit(""))
    near = F.filter(paragraphs(text), lambda p: F.rlike(_spelt(p), F.lit(gate)))
    judged = F.filter(F.transform(near, lambda p: classify(normal_words(_spelt(p)), model)), lambda r: F.size(r) > 0)
    name = fresh(docs, "licenses_")
    out = docs.withColumn(name, F.when(F.rlike(_spelt(text), F.lit(gate)), judged).otherwise(F.array()))
    every = F.flatten(name)
    sure = F.filter(every, lambda r: r["confirmed"])
    top = F.get(
        F.array_sort(F.transform(sure, lambda r: F.struct((-r["probability"]).alias("p"), r["family"].alias("f")))), F.lit(0)
    )
    highest = F.array_max(F.transform(every, lambda r: r["probability"]))
    found = {
        "license": F.when(F.size(sure) > 0, top["f"]).when(F.size(name) > 0, UNKNOWN),
        "license_probability": F.when(F.size(sure) > 0, -top["p"]).when(F.size(name) > 0, highest),
        "license_families": F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda r: r["family"]))), ","),
        "n_license_paragraphs": F.size(name),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in found]
    return out.select(*kept, *[value.alias(c) for c, value in found.items()])
