"""Licence scan by canonical digests of entire texts.

A text is normalised: lower case, copyright lines out, equivalent spellings made one, runs of punctuation, signs and white space
made one space. Its SHA-256 is looked up among those of the known licences, which were normalised the same way. The known ones
are LICENSES, those below and those of licenses.json: entire texts by their SPDX id, as they are published and, as -terms, up to the
end of the terms; standard notices; lines. Their table is broadcast.

A null or empty text has the digest of an empty one, which is no licence's. Copies give a row each.
"""

from __future__ import annotations

import json
import pkgutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line that names a holder.
COPYRIGHT_LINE = r"(^|\n)[ \t]*((copyright[ \t]+)?(\(c\)|©)|copyright[ \t]+[0-9]{4}|all[ \t]+rights[ \t]+reserved)[^\n]*"
#: Equivalent spellings of texts whose words stand one space apart, fixed values.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("whilst", "while"),
    ("http ", "https "),
    ("copyright holder", "copyright owner"),
]
SEPARATORS = r"[\p{P}\p{S}\p{Z}\p{C}]+"

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known texts, without their titles and holders: public licences and short notices.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
    + _WARRANTY
    + """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END,
    "0BSD": _ISC + "." + _ISC_END,
    "BSD-2-Clause": _BSD_2 + _BSD_END,
    "BSD-3-Clause": _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
} | json.loads(pkgutil.get_data(__package__, "licenses.json"))


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), SEPARATORS, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def with_license(docs: DataFrame, text: str = "text", licenses: dict[str, str] | None = None) -> DataFrame:
    """docs with license_digest and license_id, the latter null if no known licence has the digest. Columns of these names are replaced."""
    docs = docs.drop("license_digest", "license_id")
    known = docs.sparkSession.createDataFrame(list((licenses or LICENSES).items()), "license_id string, license_text string")
    known = known.select(F.sha2(canonical(F.col("license_text")), 256).alias("license_digest"), "license_id").groupBy("license_digest").agg(F.min("license_id").alias("license_id"))
    return docs.withColumn("license_digest", F.sha2(canonical(F.col(f"`{text}`").cast("string")), 256)).join(F.broadcast(known), "license_digest", "left")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_license(docs).select("doc_id", "license_digest", "license_id")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"regexp_replace(replace({out}, '&', ' and '), {_quoted(SEPARATORS)}, ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return f"trim({out})"


def oracle() -> str:
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in LICENSES.items())
    return f"""WITH known AS (SELECT sha256({_canonical_sql("t")}) AS license_digest, min(id) AS license_id FROM (VALUES {known}) AS v(id, t) GROUP BY 1),
docs AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS license_digest FROM documents)
SELECT d.doc_id, d.license_digest, k.license_id FROM docs d LEFT JOIN known k USING (license_digest)"""
