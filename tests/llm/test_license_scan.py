"""Licence rules against known headers, and the oracle."""

from __future__ import annotations

import duckdb
import pytest

from tracklens.llm import license_scan

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software. The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that: Redistributions of source code must retain the above copyright notice.
Redistributions in binary form must reproduce the above copyright notice. {}"""
ENDORSE = "Neither the name of X nor its members may be used to endorse or promote products derived from this."
TEXTS = {
    MIT: "MIT",
    BSD.format(""): "BSD-2-Clause",
    BSD.format(ENDORSE): "BSD-3-Clause",
    "words. Licensed under the Apache License, Version 2.0. more": "Apache-2.0",
    "# SPDX-License-Identifier: MIT": "MIT",
    "This program is free software: you can redistribute it under the GNU General Public License, either version 3 "
    "of the License, or (at your option) any later version.": "GPL-3.0-or-later",
    "All rights reserved.": "",
    "No licence here, only permission to speak.": "",
    "": "",
    "| licensed under the | MIT | License |": "MIT",
    "// SPDX-License-Identifier: GPL-2.0-or-later\n#include <x.h>": "GPL-2.0-or-later",
    "// SPDX-License-Identifier: GPL-2.0+\nint x = 2+2;": "GPL-2.0-or-later",
    "# SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
    "/* SPDX-License-Identifier: (LGPL-2.1-or-later AND ( ISC OR AGPL-3.0-only )) */ code": "AGPL-3.0-only,ISC,LGPL-2.1-or-later",
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND BSD-3-Clause": "BSD-3-Clause,GPL-2.0-only WITH Classpath-exception-2.0",
    "Text before. SPDX-License-Identifier: ISC and words after it": "ISC",
    "SPDX-License-Identifier: LicenseRef-ours OR MIT": "MIT",
    "SPDX-License-Identifier: <none>": "",
    "This is not under the MIT License.": "",
    "It is not licensed under the GNU General Public License version 2.": "",
}


NOTICE = """This {0} is free software{1} you can redistribute it and/or modify
it under the terms of the GNU {2}General Public License as published by
the Free Software Foundation{3} either version {4} of the License, or
(at your option) any later version.

This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {2}General Public License for more details.

You should have received a copy of the GNU {2}General Public License
along with this {0}; if not, write to the Free Software Foundation, Inc."""
NOTICES = {
    NOTICE.format("program", ";", "", ";", "2"): "GPL-2.0-or-later",
    NOTICE.format("library", ";", "Lesser ", ";", "2.1"): "LGPL-2.1-or-later",
    NOTICE.format("library", ";", "Library ", ";", "2"): "LGPL-2.0-or-later",
    NOTICE.format("library", ";", "Lesser ", ";", "3"): "LGPL-3.0-or-later",
    NOTICE.format("program", ":", "Lesser ", ",", "3"): "LGPL-3.0-or-later",
    NOTICE.format("program", ":", "", ",", "3"): "GPL-3.0-or-later",
    NOTICE.format("program", ":", "Affero ", ",", "3"): "AGPL-3.0-or-later",
    NOTICE.format("program", ";", "Affero ", ";", "3"): "AGPL-3.0-or-later",
    "under the GNU General Public License as published by the Free Software Foundation; either version 2, or (at your option) any later version.": "GPL-2.0-or-later",
    "under the GNU General Public License as published by the Free Software Foundation; version 2 of the License.": "GPL-2.0",
}


def test_gnu_notices(spark):
    rows = [(i, t) for i, t in enumerate(NOTICES)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.licenses, r.unresolved) for r in got] == [(want, "") for want in NOTICES.values()]
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(map(tuple, got)) == sorted(con.sql(license_scan.oracle()).fetchall())


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (91, "word " * 200_000 + ". MIT License. "), (None, MIT), (0, MIT)]


def test_rules(spark, rows):
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, want in enumerate(TEXTS.values()):
        assert by_id[i].licenses == want, i
    assert by_id[6].unresolved == "rights" and by_id[90].n_sentences == 0
    assert by_id[91].licenses == "MIT" and by_id[None].licenses == "MIT"


def test_every_pattern_has_a_cue():
    import re

    for _, pattern in license_scan.SENTENCES:
        for part in pattern.split("|") if "(" not in pattern else [pattern]:
            assert re.search(license_scan.CUE, part), part


def test_oracle(spark, rows):
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t) for i, t in rows if i is not None], columns=["doc_id", "text"]))
    got = license_scan.scan_licenses(spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string"))
    want = con.sql(license_scan.oracle()).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_and_clashing_columns(spark):
    kinds = "licenses int, text string, ids string, marked string, doc_id long"
    assert license_scan.scan_licenses(spark.createDataFrame([], kinds)).count() == 0
    assert license_scan.scan_licenses(spark.createDataFrame([(1, MIT, "a", "b", 5)], kinds)).first().licenses == "MIT"


def test_no_python_in_the_plan(spark):
    df = license_scan.scan_licenses(spark.createDataFrame([(1, MIT)], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
