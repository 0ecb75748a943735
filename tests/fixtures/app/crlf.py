def f():
    "doc"
    return 1
