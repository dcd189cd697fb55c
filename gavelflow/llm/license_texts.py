"""Notices that the license scan looks for.

Fixed values: the wording of public license notices.
"""

TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "mit-line": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:"),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc0-line": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "all-rights-reserved": "All rights reserved.",
    "apache-1.1-line": "Licensed under the Apache License, Version 1.1.",
    "bsd-line": "Released under the BSD License.",
    "bsd-conditions": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution."),
    "bsd-no-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission."),
    "bsd-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
        "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."),
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "lgpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "epl-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0/"),
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-nd-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-line": "Licensed under CC BY-NC-ND 4.0.",
}

#: Word runs that tell a notice from its neighbours; each stands unbroken inside the notice. Of runs
#: parted by a bar, one is enough.
DISTINGUISHING = {
    "apache-2.0-line": ["apache license", "version 2.0|license 2.0|v2.0"],
    "apache-2.0-header": ["apache license", "version 2.0|license 2.0|v2.0"],
    "apache-1.1-line": ["apache license", "version 1.1|license 1.1|v1.1"],
    "mit-line": ["mit"],
    "bsd-line": ["bsd"],
    "bsd-no-endorsement": ["neither the name"],
    "gpl-3.0-line": ["gnu general public license", "version 3|version 3.0|license 3|v3"],
    "gpl-header": ["gnu general public license", "version 3|version 3.0"],
    "gpl-2.0-line": ["gnu general public license", "version 2|version 2.0|license 2|v2"],
    "gpl-2.0-header": ["gnu general public license", "version 2|version 2.0"],
    "lgpl-2.1-header": ["gnu lesser general public license", "version 2.1"],
    "lgpl-3.0-header": ["gnu lesser general public license", "version 3|version 3.0"],
    "agpl-3.0-header": ["gnu affero general public license", "version 3|version 3.0"],
    "mpl-2.0-header": ["mozilla public license", "v 2.0|version 2.0|license 2.0"],
    "epl-2.0-header": ["eclipse public license", "license 2.0|v 2.0|version 2.0"],
    "cc-by-line": ["creative commons attribution 4.0"],
    "cc-by-short": ["cc by 4.0"],
    "cc-by-nc-line": ["cc by-nc 4.0"],
    "cc-by-sa-line": ["cc by-sa 4.0"],
    "cc-by-nd-line": ["cc by-nd 4.0"],
    "cc-by-nc-sa-line": ["cc by-nc-sa 4.0"],
    "cc-by-nc-nd-line": ["cc by-nc-nd 4.0"],
    "cc0-line": ["cc0 1.0"],
}
