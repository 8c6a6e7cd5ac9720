"""Licence texts and one-line notices that a scan looks for, by SPDX-like name.

Fixed values: the published wording of short licences, without copyright lines (the scan
drops those), and common notices.
"""

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
_MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

KNOWN = {
    "MIT": "MIT License\n\n" + _MIT_GRANT + _MIT_AS_IS,
    "MIT-untitled": _MIT_GRANT + _MIT_AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_AS_IS,
    "BSD-2-Clause": _BSD_TERMS + _BSD_AS_IS,
    "BSD-3-Clause": _BSD_TERMS + _BSD_NAME + _BSD_AS_IS,
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "reserved-notice": "All rights reserved.",
}

#: Digests of the canonical form of whole texts that are too long to hold here, as published
#: with common distributions: the whole file and, where an appendix tells how to apply it, the
#: terms without it, with and without the line that ends them.
WHOLE = {
    "Apache-2.0": ["8f86909a6dbf3a124c7a7d11b3aaf31f", "0b86eecc1e7d2e8a032c6949313ee428", "c13f45eb6f6ea48b718436651bf73c9a"],
    "Artistic-1.0-Perl": ["a8b0fb0c6e43a3b36bdc159e59dbfd1e"],
    "CC0-1.0": ["93a180096f6cfcf2c0dd24f75c2eec48"],
    "GFDL-1.2": ["fc8fd4dca9351a1b1ba045c2a7d3d70f"],
    "GFDL-1.3": ["3564867804d3e20f9506651fedbca0e9"],
    "GPL-1.0": ["738cc3b112640d95d4cd79a58967ecea", "21fa8693acc5194a648fe02e11f65a72", "dbf3c47f5a8f127e58d08cabc1ebb916"],
    "GPL-2.0": ["5e39ace6e62f5a7fe9c17b4da986ad8c", "f2c06efe640b4a281cbe5337cdde80ab", "68380dbeadb093b94ecf563db7312db7"],
    "GPL-3.0": ["5eaa767cc0a56c87c3852144458a3bf1", "17e434cc6db7003444b088cb4cc81e91", "444f95dc767ede978b60cfb20fbd0bca"],
    "LGPL-2.0": ["74cf7fcef3b29a39165a795b2cad3a3a", "97832943be1e344d51af5aee1b658e4f", "c396ba2f94537628797123bc12cd2d6e"],
    "LGPL-2.1": ["f998bc436710cfece156aaa84fd26dd4", "eaf6afb73fc860a002bfbccbe6f07ce7", "3054b3781b1af43f906dc753acad15ee"],
    "LGPL-3.0": ["b31b7335bc37919e8cdd79154e04d88d"],
    "MPL-1.1": ["9cdb0c94cb45abb55c616e067859d4ad"],
    "MPL-2.0": ["7d4b8b0889da3c01eff3fe431102e6d6"],
    "BSD-3-Clause-UC": ["6989781d8e3e31bf06f590dd203d4e65"],
}
