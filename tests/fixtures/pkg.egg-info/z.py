def dropped():
    pass
