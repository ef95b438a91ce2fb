import math
import random
import re

from tidemark.llm.license_scan import TEMPLATES, licensed

WORDS = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]


def brute(rows, threshold=0.6):
    n, df = len(rows), {}
    for _, _, t in rows:
        for w in set(WORDS(t or "")):
            df[w] = df.get(w, 0) + 1
    known = {w for _, t in TEMPLATES for w in WORDS(t)}
    idf = lambda w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 if w in known else 1.0
    vec = lambda t: {w: WORDS(t).count(w) * idf(w) for w in set(WORDS(t))}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for i, path, t in rows:
        whole = bool(re.search(r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)(\.(txt|md|rst))?$", path or ""))
        best = None
        for u, line in [(-1, t or "")] if whole else list(enumerate((t or "").split("\n"))):
            v = vec(line)
            for k, (name, text) in enumerate(TEMPLATES):
                w = vec(text)
                s = round(sum(x * w.get(y, 0) for y, x in v.items()) / (norm(v) * norm(w)), 9) if v else 0
                if s >= threshold:
                    best = max(best or (0,), (s, -u, -k, name))
        out[i] = (path, whole, best)
    res = {}
    for i, (path, _, best) in out.items():
        if best:
            res[i] = (best[3], best[0], "own", None)
            continue
        found, folder = None, path.rpartition("/")[0] if path is not None else None
        while folder is not None and not found:
            holders = [(b[0], p, b[3]) for p, w, b in out.values() if w and b and p.rpartition("/")[0] == folder]
            found = max(holders, default=None)
            folder = folder.rpartition("/")[0] if folder else None
        res[i] = (found[2], found[0], "inherited", found[1]) if found else (None, None, None, None)
    return res


def test_equals_brute_force(spark):
    r = random.Random(3)
    vocab = ["the", "of", "license", "under", "version", "x1", "y2", "z3", "software", "this"]
    say = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(1, 15)))
    rows = []
    for i in range(120):
        lines = [say() for _ in range(r.randint(0, 4))]
        if r.random() < 0.3:
            lines.insert(r.randint(0, len(lines)), "// Copyright 2020 Me. " + r.choice(TEMPLATES)[1] + ".")
        folder = "/".join(r.choice(["a", "b", "c"]) for _ in range(r.randint(0, 3)))
        name = r.choice(["LICENSE", "COPYING.txt"]) if r.random() < 0.12 else f"f{i}.py"
        rows.append((i, f"{folder}/{name}" if folder else name, r.choice(TEMPLATES)[1] if name[0] in "LC" else "\n".join(lines)))
    rows += [(500, None, TEMPLATES[0][1]), (501, None, "x"), (502, "a/n.txt", None), (503, "a/m.txt", "")]
    df = spark.createDataFrame([(*x, "u", 0.0) for x in rows], "doc_id long, path string, text string, unit string, score double")
    got = {x.doc_id: (x.license, x.score, x.origin, x.licensed_by) for x in licensed(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][0] == w[0] and got[i][2:] == w[2:] and (w[1] is None or abs(got[i][1] - w[1]) < 1e-8), (i, got[i], w)
    assert licensed(df.limit(0)).collect() == []


def test_notices_in_long_lines_and_wrapped_headers(spark):
    r = random.Random(4)
    prose = lambda n: " ".join("w%d" % r.randrange(60) for _ in range(n))
    rows, want = [], {}
    for k, (name, text) in enumerate(TEMPLATES):
        words = text.split()
        wrapped = "\n".join("# " + " ".join(words[a : a + 2]) for a in range(0, len(words), 2))
        for n, made in enumerate((prose(400) + " " + text + " " + prose(300), prose(900) + " " + text + ".", prose(30) + "\n" + wrapped + "\n" + prose(30), prose(9) + "\n" + prose(60) + " " + words[0] + "\n" + " ".join(words[1:]) + " " + prose(60))):
            rows.append((10 * k + n, f"a/f{k}_{n}.txt", made))
            want[10 * k + n] = name
    rows += [(1000 + i, f"a/p{i}.txt", "\n".join([prose(200), prose(5)])) for i in range(40)] + [(2000, "a/both.txt", prose(300) + " " + TEMPLATES[3][1] + " " + prose(50) + "\n" + "x" + "\n" + prose(40))]
    want[2000] = "MIT"
    rows.append((2001, "a/two.txt", "This work is licensed under the GNU General Public License,\nversion 2\n" + prose(40)))  # its first line fits GPL-3.0 as well
    want[2001] = "GPL-2.0"
    got = {x.doc_id: (x.license, x.score, x.origin, x.unit) for x in licensed(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert len(got) == len(rows)
    for i, *_ in rows:
        assert got[i][0] == want.get(i), (i, got[i], want.get(i))
    assert got[2000][2:] == ("own", 0) and got[2][3] == 1


MIT = """MIT License

Copyright (c) 2021 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2020, Somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
APACHE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License.
"""
GPL = """                    GNU GENERAL PUBLIC LICENSE
                       Version {}

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""


def test_whole_licence_files_and_what_they_cover(spark):
    files = {"mit": (MIT, "MIT"), "bsd3": (BSD + THIRD + WARRANTY, "BSD-3-Clause"), "bsd2": (BSD + WARRANTY, "BSD-2-Clause"), "apache": (APACHE, "Apache-2.0"), "gpl3": (GPL.format("3, 29 June 2007"), "GPL-3.0"), "gpl2": (GPL.format("2, June 1991"), "GPL-2.0")}
    rows, want = [], {}
    for k, (name, (text, license_)) in enumerate(files.items()):
        for n, (path, body) in enumerate(((f"{name}/LICENSE", text), (f"{name}/src/deep/a.py", "print(1)"), (f"{name}/b.py", None))):
            rows.append((10 * k + n, path, body))
            want[10 * k + n] = (license_, "own" if n == 0 else "inherited")
    rows += [(900, "other/a.py", "x " * 50_000), (900, "other/a.py", "x " * 50_000), (None, "mit/c.py", "y")]
    want[900] = (None, None)
    got = licensed(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert len(got) == len(rows) - 1 and {x.doc_id: (x.license, x.origin) for x in got} == want
    assert all(x.unit == -1 for x in got if x.origin == "own")
