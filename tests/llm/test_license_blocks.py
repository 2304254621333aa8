from unifold.llm import licenses


def test_no_license_is_crowded_out(spark):
    filler = " ".join(f"word{i}" for i in range(26_000))
    rows = [
        (1, "Copyright 2020 Acme Inc. All rights reserved. This work is licensed under the GNU General Public License, version 3."),
        (2, "Licensed under the GNU General Public License, version 3; samples: Released under the MIT License."),
        (3, f"{filler} Released under the MIT License. {filler}"),
    ]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "GPL-3.0"), (1, "proprietary"), (2, "GPL-3.0"), (2, "MIT"), (3, "MIT")}


def test_wrapped_notices(spark):
    rows = [
        (1, "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated files"),
        (2, " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"),
        (3, "it under the terms of the GNU General\nPublic License as published by\nthe Free Software Foundation, either version 3 of the License"),
        (4, "text\n\n// Licensed under the Apache License,\n// Version 2.0 (the License)\nReleased under the MIT License"),
        (5, "Licensed under the Apache\nmanual, Version 2.0"),
    ]
    got = {(r.doc_id, r.line, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0, "MIT"), (2, 0, "BSD-3-Clause"), (3, 0, "GPL-3.0"), (4, 2, "Apache-2.0"), (4, 4, "MIT")}
