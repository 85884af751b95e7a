"""Public license notices used as templates of the license scan (fixed texts).

Notices and short license texts, not the bodies of the long licenses: those come in
as a table or a dictionary of the caller (``scan_licenses(templates=...)``)."""

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met: Redistributions of
source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution.""",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met: Redistributions of
source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution. Neither the name of the copyright holder nor the names
of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "EPL-1.0": """This program and the accompanying materials are made available under the terms of
the Eclipse Public License v1.0""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of
the Eclipse Public License 2.0""",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free Software Foundation;
either version 2 of the License, or (at your option) any later version.""",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or modify it
under the terms of the GNU Lesser General Public License as published by the Free Software
Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0-header": """This library is free software: you can redistribute it and/or modify it
under the terms of the GNU Lesser General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version.""",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it
under the terms of the GNU Affero General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version.""",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License,
v. 2.0.""",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright.",
    "proprietary": "All rights reserved.",
}

# the Creative Commons variants and versions
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
       "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _kind, _name in _CC.items():
    for _version in ("2.0", "2.5", "3.0", "4.0"):
        TEMPLATES.setdefault(f"CC-{_kind}-{_version}", f"Licensed under CC {_kind} {_version}.")
        _scope = "International" if _version == "4.0" else "Unported" if _version == "3.0" else "Generic"
        TEMPLATES[f"CC-{_kind}-{_version}-name"] = (
            f"licensed under a Creative Commons {_name} {_version} {_scope} License")

#: Words that tell the licenses of a family apart: a notice that has the family's word must
#: have exactly those of the template. Version numbers of the template must all be there.
VARIANTS = {
    "cc": {"nc", "nd", "sa"},
    "commons": {"noncommercial", "noderivatives", "noderivs", "sharealike"},
    "gnu": {"lesser", "affero", "library"},
}
