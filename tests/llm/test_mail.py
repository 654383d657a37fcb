import base64

from stranda.llm.mail import header_end, text_parts


def parts(text):
    return list(text_parts(text))


def test_plain_and_odd_mails():
    assert parts("From: a\n\nbody\n") == ["body\n"]
    assert parts("From: a\r\n\r\nbody\r\n") == ["body\r\n"]
    assert parts("\nbody") == ["body"] and parts("From: a\nno body") == [""] and parts("") == [""]
    assert header_end("a: b\n\nc") == 5 and header_end("a: b") == 4 and header_end("\nx") == 0


def test_encodings():
    b64 = base64.encodebytes("Grüße an alle".encode()).decode()
    assert parts(f"CONTENT-TYPE: text/plain;\n\tcharset=utf-8\nContent-Transfer-Encoding: BASE64\n\n{b64}") == ["Grüße an alle"]
    assert parts(f"Content-Transfer-Encoding: base64\n\n{b64[:-3]}*") == ["Grüße an al"]
    assert parts("Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\nGr=FC=DFe, lo=\nng") == ["Grüße, long"]


def test_html():
    assert parts("Content-Type: text/html\n\n<p>a&nbsp;<b>b</b>c &lt;d&gt;</p><!-- <x> -->\n1 < 2") == ["a\xa0bc <d>\n1 < 2"]


def test_multiparts():
    mail = 'Content-Type: multipart/mixed; boundary="b"\n\npreamble\n--b\nContent-Type: multipart/alternative; boundary=b2\n\n--b2\n\none\n--b2\nContent-Type: text/html\n\n<i>two</i>\n--b2--\n--b\nContent-Type: application/pdf\n\nno\n--b--\nepilogue'
    assert parts(mail) == ["one", "two"]
    assert parts("Content-Type: multipart/mixed; boundary=b\n\n--b\n\nopen end") == ["open end"]
    assert parts("Content-Type: multipart/mixed; boundary=b\n\nno delimiter") == ["no delimiter"]
    assert parts("Content-Type: multipart/mixed\n\nno boundary") == ["no boundary"]
