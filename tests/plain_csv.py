"""A character-by-character CSV reader to hold the distributed one against."""


class BadRecord(Exception):
    pass


def records(text: str):
    """Yield records; raise BadRecord at the first one that is no CSV."""
    i, n = 0, len(text)

    def line_end(i):
        if text[i] == "\r":
            return 2 if i + 1 < n and text[i + 1] == "\n" else 1
        return 1 if text[i] == "\n" else 0

    while i < n:
        if line_end(i):             # an empty line is no record
            i += line_end(i)
            continue
        fields = []
        while True:
            if i < n and text[i] == '"':
                i += 1
                value = []
                while True:
                    if i >= n:
                        raise BadRecord("open quote")
                    if text[i] != '"':
                        value.append(text[i])
                        i += 1
                    elif i + 1 < n and text[i + 1] == '"':
                        value.append('"')
                        i += 2
                    else:
                        i += 1
                        break
                while i < n and text[i] != "," and not line_end(i):
                    if not text[i].isspace():
                        raise BadRecord("text after quote")
                    i += 1
                fields.append("".join(value))
            else:
                start = i
                while i < n and text[i] != "," and not line_end(i):
                    i += 1
                fields.append(text[start:i])
            if i < n and text[i] == ",":
                i += 1
                continue
            if i < n:
                i += line_end(i)
            break
        yield fields


def read(text: str):
    """(header or None, good data records, whether the file is broken)."""
    found, broken = [], False
    try:
        for record in records(text):
            found.append(record)
    except BadRecord:
        broken = True
    return (found[0] if found else None), found[1:], broken
